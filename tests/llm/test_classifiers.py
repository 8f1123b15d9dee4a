"""Quality and toxicity: held-out accuracy, fitting steps and odd inputs."""

import numpy as np
import pytest
from zlib import crc32

from tabloom.llm import quality, queries, toxicity

from .edges import ROWS, no_documents, odd_documents

SMALL = "/root/testdata/sf0.01"


def auc(y, score):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(
    "name, label, threshold", [("op2_quality_classifier", "quality", 0.3), ("op4_toxicity", "toxic", 0.5)]
)
def test_held_out_accuracy(spark, name, label, threshold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, SMALL).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= threshold) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    y, score, predicted = map(np.array, zip(*held))
    assert auc(y, score) > 0.97 and (y == predicted).mean() > 0.95


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_documents(spark, score):
    name = "quality" if score is quality.score_quality else "toxic"
    labels = spark.createDataFrame(
        [(1, 1), (4, 0), (5, 1), (5, 1), (6, 0), (7, None), (None, 1), (99, 0)], f"doc_id long, {name} int"
    )
    for given in (labels, labels.where("false"), labels.where(f"{name} = 1")):
        rows = score(odd_documents(spark), given).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert score(no_documents(spark), labels).count() == 0


@pytest.mark.parametrize("drop, name", [(quality.drop_low_quality, "quality"), (toxicity.drop_toxic, "toxic")])
def test_filters_keep_all_columns(spark, drop, name):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (6, 0)], f"doc_id long, {name} int")
    odd = odd_documents(spark)
    kept = drop(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert {r.n for r in kept.collect()} <= {"clash"}


def test_dual_descent_separates():
    r = np.random.default_rng(0)
    rows, y = [], np.array([i % 4 != 0 for i in range(400)], float)
    for label in y:
        own = r.integers(0, 50, 5) + (0 if label else 50)
        rows.append(np.unique(np.concatenate([own, r.integers(200, 3000, 20)])))
    model = quality.fit(rows[:300], y[:300], np.arange(300) % 3)
    score = np.array([model.score(x) for x in rows[300:]])
    assert ((score >= 0.5) == y[300:]).mean() > 0.97
    ratios = quality.log_ratios(rows, y)
    assert ratios[:50].mean() > 0 > ratios[50:100].mean()


def test_isotonic_steps_are_the_block_means():
    raw, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 1, 1, 0])
    knots, levels = toxicity.isotonic(raw, y)
    assert levels == sorted(levels)
    fitted = np.interp(raw, knots, levels)
    assert np.allclose(fitted, [0, 0.5, 0.5, 2 / 3, 2 / 3, 2 / 3])


def test_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = toxicity.boost(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.98


@pytest.mark.parametrize(
    "word, stem", [("IDIOT!!", "idio"), ("1d10t", "idio"), ("(Él)", "él"), ("***", ""), ("a", "a"), ("123", "")]
)
def test_stems(word, stem):
    assert toxicity.stem(word) == stem


def test_disguised_words_count():
    lexicon = {"idio": 3.0}
    plain, hidden = (toxicity.features(t, lexicon) for t in ("you idiot man", "you 1d1ot man"))
    assert plain[0] == hidden[0] == 1 / 3 and plain[4] == hidden[4] == 1 / 3
    assert plain[11] == 0 < hidden[11]


def test_a_worker_keeps_the_tables_of_one_operator():
    """Words of the toxicity and quality stages leave the worker when the next operator's tables come."""
    from tabloom.llm import common, sentencepieces

    toxicity.features("some words here", {})
    assert {"some", "words", "here"} <= common._kept["stems"].keys()
    quality.indicators("some words here")
    assert list(common._kept) == ["shapes"] and set(common._kept["shapes"]) == {"some", "words", "here"}
    table = sentencepieces.chunk_table("piece_bpe_32k.model")
    assert len(common._kept) == 1 and sentencepieces.chunk_table("piece_bpe_32k.model") is table
    ids, back = table.of_texts(["some words here"])[0]
    assert back == "some words here" and not table.texts  # texts that come back as they went in are held once
    toxicity.features("some words here", {})
    assert list(common._kept) == ["stems"]
