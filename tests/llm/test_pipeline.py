import random

import pytest

import corpus_pipeline
from cohortlens.llm.queries import oracle_sql, queries
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    verdict = compare(spark, connect(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_every_operator_has_a_query():
    assert [f"op{n}" for n in range(1, 14)] == [x.split("_")[0] for x in queries() if x.startswith("op")]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    sentence = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(30)) + "."
    text = lambda n=4: "\n".join(sentence() for _ in range(n))
    shared, item = sentence(), sentence()
    base = text(8)
    docs = [(i, text() + "\n" + shared) for i in range(1, 8)]
    docs += [(20, base), (21, base), (22, base.replace("w1", "v1", 1)), (30, text() + " " + item), (40, "short"), (50, None), (None, text())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, apply in corpus_pipeline.STAGES[:-1]:
        read = apply(spark, read, str(tmp_path))
        columns = columns or read.columns
        assert read.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(done) == {1, 2, 3, 4, 5, 6, 7, 20, None}
    assert [shared in done[i]["text"] for i in range(1, 8)] == [False] * 6 + [True]
    assert all(r["ids"] for r in done.values())
    assert {r["doc_id"] for r in read.collect()} == set(done)


def test_stages_are_the_dealt_ones():
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None
