"""Corpus scan, snapshots, judgments, the event log and incremental upkeep."""

import json
import subprocess
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomsearch import cli
from loomsearch.operators import features, fields, index, query
from loomsearch.sources import corpus, tables
from loomsearch.streaming import event_log as log
from loomsearch.streaming import maintenance as up

FILES = {"src/lib.rs": "needle token", "vendor/generated/client.rs": "needle", "README.md": "# The running parser", ".hidden": "h", "out/x.log": "ignored", "keep.log": "kept", ".gitignore": "*.log\n!keep.log\nout/\n", ".git/config": "x"}


@pytest.fixture
def root(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "binary.bin").write_bytes(b"\xff\xfe")
    return tmp_path


def test_scan(spark, root):
    docs, rejects = corpus.scan(spark, str(root))
    assert {r["path"] for r in docs.collect()} == {"src/lib.rs", "vendor/generated/client.rs", "README.md", ".hidden", "keep.log", ".gitignore"}
    assert [(r["path"], r["reason_kind"]) for r in rejects.collect()] == [("binary.bin", "read")]
    assert "out/x.log" in corpus.list_files(str(root), respect_gitignore=False) and corpus.build_report(docs, rejects).first() == (6, 1)
    short = corpus.scan(spark, str(root), prefix="src")[0]
    assert "lib.rs" in {r["path"] for r in short.collect()}


def test_snapshot(spark, root, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snap"))
    docs = corpus.scan(spark, str(root))[0]
    posts = index.postings(docs, "doc_id", "content")
    config = tables.config_hash()
    assert not tables.snapshot_exists(spark, folder)
    tables.write_snapshot(folder, {"docs": docs, "postings": posts}, str(root), config)
    back = tables.load_snapshot(spark, folder, str(root), config)
    assert sorted(map(tuple, back["postings"].collect())) == sorted(map(tuple, posts.collect()))
    assert tables.lexicon_entry(back, "needle").first() == ("needle", 2, 2) and tables.lexicon_size(back) == posts.select("term").distinct().count()
    plan = tables.postings_of(back, "needle")._jdf.queryExecution().toString()
    assert "EqualTo(term,needle)" in plan
    for where, conf in ((str(root) + "x", config), (str(root), tables.config_hash(2))):
        with pytest.raises(tables.SnapshotMismatch):
            tables.load_snapshot(spark, folder, where, conf)
    with pytest.raises(ValueError):
        tables.config_hash(0)


JUDGMENTS = {"repo": "r", "examples": [{"query": "needle", "query_shape": "identifier", "results": [{"path": "src/lib.rs", "relevant": True, "rank": 1, "evidence": [{"start_line": 1, "end_line": 1, "snippet": "needle"}]}, {"path": "README.md", "relevant": False}]}]}


def test_judgments(spark, tmp_path):
    f = tmp_path / "j.json"
    f.write_text(json.dumps(JUDGMENTS))
    queries, judged, evidence = tables.read_judgments(spark, str(f))
    assert queries.first() == ("q1", "needle", "identifier") and judged.collect() == [("q1", "src/lib.rs", 1)] and evidence.first()["snippet"] == "needle"
    bad = json.loads(json.dumps(JUDGMENTS))
    del bad["examples"][0]["results"][0]["rank"]
    f.write_text(json.dumps(bad))
    with pytest.raises(PySparkException, match="without rank"):
        tables.read_judgments(spark, str(f))[1].collect()


def test_feature_lines_and_baseline(spark, tmp_path):
    judged = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2)], "query_id string, path string, relevance int")
    rows = spark.createDataFrame([("q1", "t", "path", "a", 1, 1, {"x": 1.5}, {"t": "feedback"})], "query_id string, query string, query_intent string, doc_path string, rank int, relevance int, features map<string,double>, expansion_provenance map<string,string>")
    tables.write_features(rows, features.pairwise_preferences(judged), str(tmp_path / "f"))
    a, b = tables.read_features(spark, str(tmp_path / "f"))
    assert a.first()["features"] == {"x": 1.5} and b.first()["preferred_doc"] == "a"
    (tmp_path / "b.json").write_text('{"recall_at_k": 0.5}')
    assert tables.read_baseline(spark, str(tmp_path / "b.json"))["aggregate"] == {"recall_at_k": 0.5}
    for q in ("a", "b"):
        tables.log_query(spark, str(tmp_path / "log"), q, 1)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_event_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert log.read_events(spark, folder).count() == 0
    some = lambda *rows: spark.createDataFrame(rows, "kind string, path string")
    log.append_events(some((log.ADDED, "a"), (log.MODIFIED, "b")), folder)
    log.append_events(some((log.DELETED, "a")), folder)
    assert [tuple(r) for r in log.read_events(spark, folder).orderBy("seq").collect()] == [(0, log.ADDED, "a"), (1, log.MODIFIED, "b"), (2, log.DELETED, "a")]
    assert {r["path"]: r["kind"] for r in log.latest(log.read_events(spark, folder)).collect()} == {"a": log.DELETED, "b": log.MODIFIED}
    log.clear_events(spark, folder)
    assert log.read_events(spark, folder).count() == 0
    (tmp_path / "log" / "x.json").write_text("not json\n")
    with pytest.raises(PySparkException, match="malformed"):
        log.read_events(spark, folder).collect()


def version_of(spark, files):
    docs = spark.createDataFrame([(p, c, len(c)) for p, c in files.items()], "path string, content string, file_size_bytes bigint")
    return docs.select(F.xxhash64("path").alias("doc_id"), "*")


def rows(df):
    return sorted(map(str, df.collect()))


def test_updates_equal_a_full_build(spark):
    before = {"a.rs": "one two", "b.rs": "two", "dir/c.rs": "three", "dir/d.rs": "four"}
    after = {"a.rs": "one changed", "dir/d.rs": "four again", "new.rs": "five"}
    events = [(0, log.MODIFIED, "a.rs"), (1, log.DELETED, "b.rs"), (2, log.DELETED, "dir"), (3, log.ADDED, "dir/d.rs"), (4, log.ADDED, "new.rs"), (5, log.MODIFIED, "gone.rs")]
    df = spark.createDataFrame(events, log.SCHEMA)
    got, want = up.apply(up.build(version_of(spark, before)), df, version_of(spark, after)), up.build(version_of(spark, after))
    assert rows(got.docs) == rows(want.docs) and rows(got.tokens) == rows(want.tokens)
    assert rows(got.postings()) == rows(want.postings())
    assert rows(got.norms().select("doc_id", F.round("norm", 9))) == rows(want.norms().select("doc_id", F.round("norm", 9)))


def test_engine_follows_the_log(spark, tmp_path):
    engine = up.Engine(spark, str(tmp_path / "v"), up.build(version_of(spark, {"a": "x"})))
    old = engine.version
    folder = tmp_path / "log"
    folder.mkdir()
    stream = engine.follow(str(folder), str(tmp_path / "ck"), lambda: version_of(spark, {"a": "x", "b": "y z"}))
    try:
        (folder / "1.json").write_text(json.dumps({"seq": 0, "kind": log.ADDED, "path": "b"}) + "\n")
        for _ in range(60):
            stream.processAllAvailable()
            if engine.count() == 2:
                break
            time.sleep(0.2)
    finally:
        stream.stop()
    assert engine.count() == 2 and old.docs.count() == 1


def test_changed_files(spark):
    got = up.changed_files(version_of(spark, {"a": "1", "b": "2", "c": "3"}), version_of(spark, {"a": "1", "b": "x", "d": "4"}))
    assert {r["path"]: r["kind"] for r in got.collect()} == {"b": log.MODIFIED, "c": log.DELETED, "d": log.ADDED}


def test_command_line(spark, root, tmp_path_factory, capsys):
    place = str(tmp_path_factory.mktemp("index"))
    said = lambda *a: (cli.main(["-d", str(root), *a], spark), capsys.readouterr().out)
    assert said("regex", "needle t")[1].startswith("src/lib.rs:1-1:0..8: needle t")
    assert '"n_docs": 6' in said("--stats")[1]
    for algorithm in ("bm25f", "bm25-proximity"):
        assert said("-r", algorithm, "--index-dir", place, "needle")[1].splitlines()[0].startswith("src/lib.rs score=")
    assert "src/lib.rs" in said("-r", "ql", "--feedback-expansion", "needle")[1]
    judgments = root / "j.json"
    judgments.write_text(json.dumps(JUDGMENTS))
    code, out = said("-e", "--eval-data", str(judgments), "--export-features", place + "/f", "-r", "bm25f", "--eval-format", "json")
    assert code == 0 and json.loads(out)["aggregate"]["recall_at_k"] == 1.0
    (root / "base.json").write_text('{"recall_at_k": 2.0}')
    assert said("-e", "--eval-data", str(judgments), "-r", "bm25", "--eval-compare", str(root / "base.json"))[0] == 1
    with pytest.raises(SystemExit):
        cli.arguments(["-n", "0"])


def test_all_fields_have_their_analyser(spark):
    files = {"src/user_repo.rs": "use std::fs;\n// Running the parsers\nfn load_user() { let x = \"quoted words\"; }\n", "doc.md": "---\ntitle: Running notes\n---\n# Parsers run\nThe running parsers\n", "odd.txt": "running # a comment of sorts"}
    tokens = {(r["path"], r["field"]): r["tokens"] for r in up.tokens_of(version_of(spark, files)).collect()}
    assert tokens["src/user_repo.rs", "comments"] == ["run", "parser"] and {"titl", "run", "note", "parser"} <= {*tokens["doc.md", "content"]} and "running" not in tokens["doc.md", "content"]
    assert "running" in tokens["src/user_repo.rs", "content"] and "load_user" in tokens["src/user_repo.rs", "symbols"] and "std" in tokens["src/user_repo.rs", "imports"]
    assert tokens["src/user_repo.rs", "string_literals"] == ["quoted", "words"] and tokens["doc.md", "frontmatter"] == ["titl", "run", "note"]
    assert "run" in tokens["odd.txt", "content"] and {f for _, f in tokens} == {*fields.FIELDS}
    flat = up.tokens_of(version_of(spark, {"a.md": "the running parsers ran"}), False, 2).first()["tokens"]
    assert flat == ["run parser", "parser ran"]


def test_engine_polls_files(spark, tmp_path):
    engine = up.Engine(spark, str(tmp_path / "v"), up.build(version_of(spark, {"a": "x", "b": "y"}), False), False)
    now = version_of(spark, {"a": "x", "b": "z", "c": "w"})
    assert engine.poll(str(tmp_path / "log"), now) == 2 and engine.poll(str(tmp_path / "log"), now) == 0
    assert rows(engine.version.docs) == rows(now) and log.read_events(spark, str(tmp_path / "log")).count() == 2
    looks = iter([False, True])
    engine.watch(str(tmp_path / "log"), lambda: version_of(spark, {"a": "x"}), 0.0, lambda: next(looks))
    assert engine.count() == 1


def test_events_are_numbered_in_order(spark, tmp_path):
    folder = str(tmp_path / "log")
    for start in (0, 40):
        some = spark.range(start, start + 40, 1, 5).select(F.lit(log.ADDED).alias("kind"), F.format_string("p%03d", "id").alias("path"))
        log.append_events(some, folder)
    assert [tuple(r) for r in log.read_events(spark, folder).orderBy("seq").select("seq", "path").collect()] == [(i, f"p{i:03d}") for i in range(80)]


def test_clone(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "r").mkdir()
    git("init", "-q")
    for body in ("one", "two"):
        (tmp_path / "r" / "f").write_text(body)
        git("add", "f")
        git("commit", "-q", "-m", body)
    first = git("rev-parse", "HEAD~1")
    work = corpus.clone(str(tmp_path / "r"), first, str(tmp_path / "w"))
    assert (tmp_path / "w" / "f").read_text() == "one" and corpus.clone(str(tmp_path / "r"), first, work, fresh=True) == work
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("kept")
    with pytest.raises(ValueError, match="other files"):
        corpus.clone(str(tmp_path / "r"), first, str(tmp_path / "other"), fresh=True)


def test_stored_index(spark, root, tmp_path_factory, capsys, monkeypatch):
    place = str(tmp_path_factory.mktemp("index"))
    said = lambda *a: (cli.main(["-d", str(root), "--index-dir", place, *a], spark), capsys.readouterr().out)[1]
    plain = {}
    for algorithm in ("bm25f", "ql", "cosim"):
        plain[algorithm] = said("-r", algorithm, "needle token")
    assert said("regex", "needle t") == "src/lib.rs:1-1:0..8: needle t\n"
    with monkeypatch.context() as m:  # all comes from the stored tables
        m.setattr(up, "tokens_of", None)
        m.setattr(cli.regex_search, "trigram_postings", None)
        assert all(said("-r", a, "needle token") == p for a, p in plain.items()) and said("regex", "needle t").startswith("src/lib.rs")
    (root / "src/lib.rs").write_text("nothing here")
    (root / "new.rs").write_text("needle token of new")
    for kind in ("fielded", "grams"):
        log.append_events(spark.createDataFrame([(log.MODIFIED, "src/lib.rs"), (log.ADDED, "new.rs")], "kind string, path string"), f"{place}/{kind}/events")
    assert said("-r", "bm25f", "needle token").startswith("new.rs") and log.read_events(spark, f"{place}/fielded/events").count() == 0
    assert said("regex", "needle t") == "new.rs:1-1:0..8: needle t\n" and said("regex", "needle t") == "new.rs:1-1:0..8: needle t\n"


def test_explanations_add_up(spark, root):
    docs = corpus.scan(spark, str(root))[0]
    for algorithm in ("bm25f", "bm25-proximity", "bm25"):
        search = cli.Search(docs, algorithm)
        q = query.queries_of(spark, ['"needle token"'])
        found = search.rank(q, 5)
        got = search.explained(q, found).collect()
        assert len(got) == found.count() > 0
        for r in got:
            assert r["score"] == pytest.approx(sum(t["contribution"] for t in r["terms"]) + sum(t["contribution"] for t in r["static"]) + r["positional"], abs=1e-6)
            assert sum(f["field_contribution"] for f in r["fields"]) == pytest.approx(sum(t["contribution"] for t in r["terms"]))
