"""Files of a folder as rows. The driver lists names only; contents are read by the executors."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, content binary, file_size_bytes bigint, error string"


def _ignore_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """`(pattern, negated, folders only)` of a line of an ignore file, matched against a path from its folder."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line.removeprefix("!").removeprefix("\\")
    folders = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in line.rstrip("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*|\?|\[[^\]]*\]|.", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or ("[^" + part[2:] if part[:2] == "[!" else part if part[0] == "[" and len(part) > 1 else re.escape(part))
    return re.compile(("" if anchored else "(?:.*/)?") + out), negated, folders


def list_files(root: str, respect_gitignore: bool = True) -> list[str]:
    """Paths below `root`, relative and sorted: regular files, hidden ones too, but nothing in `.git`.

    Ignore files count only where the root is a git working copy. `root` is a path or a file-system URI.
    """
    fs, base = pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
    paths = sorted((i.path[len(base) + 1 :] for i in found if i.type == pyarrow.fs.FileType.File), key=lambda p: p.split("/"))
    paths = [p for p in paths if ".git" not in p.split("/")[:-1]]
    if not respect_gitignore or fs.get_file_info(f"{base}/.git").type == pyarrow.fs.FileType.NotFound:
        return paths
    rules: list[tuple[str, re.Pattern, bool, bool]] = []
    for p in paths:
        if p.split("/")[-1] == ".gitignore":
            with fs.open_input_stream(f"{base}/{p}") as f:
                for line in f.read().decode("utf-8", "replace").splitlines():
                    if rule := _ignore_rule(line):
                        rules.append((p[: -len(".gitignore")], *rule))

    def ignored(path: str) -> bool:
        parts = path.split("/")
        for i in range(1, len(parts) + 1):  # a folder that is ignored hides all below it
            here, verdict = "/".join(parts[:i]), False
            for folder, pattern, negated, folders in rules:
                if here.startswith(folder) and (i < len(parts) or not folders) and pattern.fullmatch(here[len(folder) :]):
                    verdict = not negated
            if verdict:
                return True
        return False

    return [p for p in paths if not ignored(p)]


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """`(path, content, file_size_bytes, error)`; a file that can't be read has an error and no content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root)
        for df in frames:
            out = []
            for p in df["path"]:
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{p}") as f:
                        data = f.read()
                    out.append((p, data, len(data), None))
                except OSError as e:
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "content", "file_size_bytes", "error"]).astype({"file_size_bytes": "Int64"})

    names = spark.createDataFrame([(p,) for p in paths], "path string")
    parts = max(1, min(len(paths) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    return names.repartition(parts, "path").mapInPandas(run, SCHEMA)


def scan(spark: SparkSession, root: str, respect_gitignore: bool = True, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Documents `(doc_id, path, content, file_size_bytes)` and rejects `(path, reason_kind, message)`.

    A document's id is a hash of its path, so it is the same in every run. `prefix` is cut off paths. Files that
    aren't UTF-8 are rejects.
    """
    raw = read_files(spark, root, list_files(root, respect_gitignore))
    if prefix:
        raw = raw.withColumn("path", F.regexp_replace("path", "^" + re.escape(prefix.rstrip("/") + "/"), ""))
    body = F.col("content").cast("string")
    good = F.col("error").isNull() & F.is_valid_utf8(body)
    docs = raw.where(good).select(F.xxhash64("path").alias("doc_id"), "path", body.alias("content"), "file_size_bytes")
    rejects = raw.where(~good).select("path", F.lit("read").alias("reason_kind"), F.coalesce("error", F.lit("invalid UTF-8")).alias("message"))
    return docs, rejects


def build_report(docs: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: indexed and skipped documents."""
    return docs.agg(F.count("*").alias("indexed")).crossJoin(rejects.agg(F.count("*").alias("skipped")))


def clone(repo: str, commit: str, workdir: str, fresh: bool = False) -> str:
    """A checkout of a commit in `workdir`, which is made anew with `fresh` or where it is none; driver-side preparation.

    A folder that isn't empty and no git working copy is never removed.
    """
    made = os.path.isdir(os.path.join(workdir, ".git"))
    if os.path.isdir(workdir) and os.listdir(workdir) and not made:
        raise ValueError(f"{workdir} holds other files")
    if made and fresh:
        shutil.rmtree(workdir)
        made = False
    if not made:
        subprocess.run(["git", "clone", "--quiet", "--", repo, workdir], check=True)
    subprocess.run(["git", "-C", workdir, "checkout", "--quiet", commit], check=True)
    return workdir
