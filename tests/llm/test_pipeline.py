"""The registered queries that have an SQL text, and the pipeline against plain versions of its stages."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import queries
from tabloom.llm.common import add_columns, vocabulary
from tabloom.llm.decontaminate import Matcher

from ..conftest import DATA
from .edges import odd_documents
from .test_dedup import brute


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = con.execute(queries.ORACLES[name])
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


def test_pipeline_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "toxicity", "quality classifier", "minhash near-dedup", "benchmark decontamination", "sentencepiece",
    ]
    scores = {
        "toxicity": ("op4_toxicity", lambda r: r.score < 0.5), "quality classifier": ("op2_quality_classifier", None),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.settle(stage(spark, kept, DATA))
        assert kept.columns == columns
        after = {r.doc_id: r.text or "" for r in kept.collect()}
        assert after.items() <= before.items() and after
        if name == "toxicity":
            rows = queries.QUERIES[scores[name][0]](spark, DATA).collect()
            assert after.keys() == {r.doc_id for r in rows if r.predicted == 0}
        if name == "minhash near-dedup":
            _, roots = brute(before, 5)
            assert after.keys() == {k for k in before if roots[k] == k}
        if name == "benchmark decontamination":
            matcher = Matcher([tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()])
            assert after.keys() == {k for k, t in before.items() if not matcher.find(t)} != before.keys()
        before = after
    processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    final = {r.doc_id: (list(r.ids), r.decoded) for r in stages["sentencepiece"](spark, kept, DATA).collect()}
    assert final == {k: (processor.encode(t), processor.decode(processor.encode(t))) for k, t in before.items()}


def test_odd_documents_pass_all_stages(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, DATA))
    assert json.dumps(docs.columns) and docs.count() > 0


def test_a_unique_text_of_a_repeated_key_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, words), (5, words), (5, other), (None, words), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS node", "'x' AS row_key")
    left = corpus_pipeline.dedup_stage(spark, docs, DATA)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(1, words), (5, other), (None, words), (7, None), (7, "")], key=str
    )


def test_stages_bound_what_a_worker_gets_at_once(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    few = spark.read.parquet(f"{DATA}/documents.parquet").limit(50)
    long = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))

    def characters():
        return lambda texts: [[sum(map(len, texts))] * len(texts)]

    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(setting)
            stage(spark, few, DATA)
            batches = add_columns(long, characters, "characters long").agg(F.max("characters"), F.count("*")).first()
            assert batches[0] < 2 << 20 and batches[1] == 600, name
        spark.conf.set(setting, "123456")  # a setting of the user's own stays
        stage(spark, few, DATA)
        assert spark.conf.get(setting) == "123456"
    finally:
        spark.conf.unset(setting)


def test_a_text_travels_once_beside_its_new_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    out = add_columns(docs, lambda: lambda texts: [[f"<{t}>" for t in texts]], "marked string")
    assert "__whole" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "<a b>"), (2, None, "<>"), (3, "", "<>")]
    numbers = add_columns(docs, lambda: lambda texts: [[t * 2 for t in texts]], "twice string", "doc_id")
    assert sorted(map(tuple, numbers.collect())) == [(1, "a b", "11"), (2, None, "22"), (3, "", "33")]
