import random

import corpus_pipeline
from loomsearch.llm import decontam, ngram_join, packing, quality
from loomsearch.llm import line_dedup as lines
from loomsearch.llm import queries


def tables(spark, docs_of, folder, odd_rows):
    r = random.Random(4)
    good, bad = [f"good{c}" for c in "abcdefghijklmnopqrstuvwxyz"], [f"junk{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(r.choice(good if i % 4 else bad) for _ in range(50))) for i in range(200)]
    rows += [(300 + i, rows[1][1] + f" tail{i}") for i in range(5)]
    rows += [(400 + i, f"{rows[5 + 4 * i][1]}\nRead page {i} of the whole story here") for i in range(12)]
    rows.append((500, rows[2][1] + " " + "benchmark words that must never be seen in the training text at all here"))
    docs_of(rows + odd_rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "benchmark words that must never be seen in the training text at all here")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs_of(rows + odd_rows)


def test_stages_give_what_the_operators_give(spark, docs_of, odd_rows, tmp_path):
    docs = tables(spark, docs_of, str(tmp_path), odd_rows)
    labels, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = quality.keep_good(docs, labels)
    kept = lines.drop_recurring(kept)
    kept = ngram_join.drop_near_duplicates(kept)
    kept = decontam.drop_contaminated(kept, items)
    expected = sorted(map(tuple, packing.pack(kept).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == expected
    ids = {r[2] for r in expected}
    assert 500 not in ids and not ids & set(range(0, 200, 4)) and not ids & set(range(301, 305))
    assert len(ids & {i for i in range(200) if i % 4}) >= 140


def test_empty_table(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_of([]), str(tmp_path)).columns == docs_of([]).columns, name


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    assert sum(k.startswith("op") for k in queries.QUERIES) == 10 and set(queries.ORACLES) < set(queries.QUERIES)
