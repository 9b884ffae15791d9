"""Static quality signals of a file and the prior they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsearch.functions import text

ENTRY_POINTS = ("main.rs", "lib.rs", "mod.rs", "main.py", "index.ts", "index.js", "main.go")
MANIFESTS = ("cargo.toml", "pyproject.toml", "package.json", "tsconfig.json", "dockerfile", "makefile", "justfile", "readme.md")
#: Weights of the flags; the explanation of a prior reads the same table.
PRIOR = {"generated": -0.55, "vendor": -0.45, "test": -0.08, "entry_point": 0.28, "readme": 0.22, "config_or_manifest": 0.20, "public_entry_point": 0.12}
SIGNALS = ["file_depth", "file_size_bytes", *PRIOR, "reference_count"]


def _lines(content: Column) -> Column:
    return F.split(F.coalesce(content, F.lit("")), r"\r?\n")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def signals(path: Column, content: Column, size: Column) -> dict[str, Column]:
    """All quality signals by name."""
    norm = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.lower(text.file_name(F.replace(path, F.lit("\\"), F.lit("/"))))
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    starts = lambda words: lambda line: F.ltrim(line).rlike("^(?:" + "|".join(words) + ")")
    return {
        "file_depth": F.greatest(F.size(parts) - 1, F.lit(0)),
        "file_size_bytes": size.cast("bigint"),
        "generated": norm.rlike(r"/generated/|/gen/|\.generated\.rs$|\.pb\.go$|\.pb\.rs$") | F.exists(F.slice(_lines(content), 1, 8), lambda x: F.contains(F.lower(x), F.lit("generated"))),
        "vendor": norm.rlike("(?:^|/)(?:vendor|node_modules|third_party|target|dist|build)/"),
        "test": norm.rlike("/tests/|/test/") | name.rlike(r"^test_|_test\.rs$|_test\.go$|\.test\.ts$|\.spec\.ts$"),
        "entry_point": name.isin(*ENTRY_POINTS),
        "readme": name.isin("readme", "readme.md"),
        "config_or_manifest": name.isin(*MANIFESTS) | name.rlike(r"\.(?:yaml|yml|toml|json)$"),
        "public_entry_point": F.exists(F.slice(_lines(content), 1, 80), starts(["pub fn main", "fn main", "pub mod ", "pub struct ", "pub enum ", "export ", "def main"])),
        "reference_count": F.size(F.filter(_lines(content), starts(["use ", "pub use ", "pub mod ", "mod ", "import ", "from ", "#include ", r"require\("]))),
    }


def prior(s: dict[str, Column]) -> dict[str, Column]:
    """Contribution of each signal to the prior."""
    depth, size = s["file_depth"], s["file_size_bytes"]
    return {
        **{k: F.when(s[k], w).otherwise(0.0) for k, w in PRIOR.items()},
        "file_depth": F.when(depth <= 1, 0.10).when(depth == 2, 0.04).when(depth <= 5, 0.0).otherwise(-0.08),
        "file_size_bytes": F.when(size > 750_000, -0.18).when(size > 250_000, -0.08).otherwise(0.0),
        "reference_count": F.least(s["reference_count"], F.lit(12)) * F.lit(0.015),
    }


def with_quality(docs: DataFrame, path: str, content: str) -> DataFrame:
    """`docs` with every signal and `static_prior`."""
    out = docs.withColumns(signals(F.col(path), F.col(content), F.octet_length(F.coalesce(content, F.lit("")))))
    return out.withColumn("static_prior", reduce(lambda a, b: a + b, prior({k: F.col(k) for k in SIGNALS}).values()))


def feature_map(s: dict[str, Column], static_prior: Column) -> Column:
    """The eleven features as a map of doubles."""
    pairs = [(k, s[k].cast("double")) for k in SIGNALS] + [("static_prior_score", static_prior)]
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
