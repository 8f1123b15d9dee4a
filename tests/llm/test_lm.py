"""Language-model scores against brute force, numeric gradients and closed sums."""

import math
from collections import Counter
from zlib import crc32

import numpy as np

from tabloom.llm import lm, queries
from tabloom.llm.lm import CLASSES, STATE, WORDS, Network

from ..conftest import DATA
from .edges import ROWS, no_documents, odd_documents, texts


def network(kind=np.float64):
    shares = np.random.default_rng(1).random(CLASSES * WORDS + 1)
    start = Network.start(shares / shares.sum())
    return Network({k: v.astype(kind) for k, v in start.p.items()})


def test_gradients_are_the_slopes_of_the_loss():
    r, m = np.random.default_rng(0), network()
    start = CLASSES * WORDS + 1
    inputs, targets = r.integers(0, start + 1, (6, 5)), r.integers(0, start, (6, 5))
    inputs[3, 2] = start
    weight = r.random((6, 5)) < 0.8
    h = r.normal(0, 0.5, (STATE, 5))
    d, _, _ = m.gradients(inputs, targets, weight, h, 7)
    for name, values in m.p.items():
        for at in np.argsort(-np.abs(d[name]).ravel())[:3]:
            place = np.unravel_index(at, values.shape)
            old, losses = values[place], []
            for step in (1e-5, -1e-5):
                values[place] = old + step
                losses.append(m.gradients(inputs, targets, weight, h, 7)[2])
            values[place] = old
            assert math.isclose(d[name][place], (losses[0] - losses[1]) / 2e-5 / 7, rel_tol=1e-4, abs_tol=1e-7)


def test_probabilities_sum_to_one():
    m, n = network(), CLASSES * WORDS + 1
    h = np.random.default_rng(3).normal(0, 0.5, (STATE, 1))
    logp, _ = m.output(np.repeat(h, n, axis=1), np.arange(n))
    assert math.isclose(np.exp(logp).sum(), 1, rel_tol=1e-9)


def test_windows_carry_the_state(monkeypatch):
    m = network(np.float32)
    r = np.random.default_rng(4)
    documents = [r.integers(0, CLASSES * WORDS + 1, n).astype(np.int32) for n in (1, 7, 100, 33, 64)]
    whole = lm.score(m, documents)
    for width in (1, 5, 1000):
        monkeypatch.setattr(lm, "WINDOW", width)
        assert np.allclose(lm.score(m, documents), whole, rtol=1e-5)
    assert np.allclose([lm.score(m, [d])[0] for d in documents], whole, rtol=1e-5)


def test_training_lowers_the_loss():
    r = np.random.default_rng(5)
    documents = [np.tile(r.permutation(4).astype(np.int32) + 10, 20) for _ in range(60)]
    m = network(np.float32)
    before = lm.score(m, documents).sum()
    for _ in range(3):
        m, seen = lm.train(m, iter(documents), 8)
    assert seen == 60 * 80 and lm.score(m, documents).sum() > 0.7 * before


def expected(docs):
    words = [(k, t.encode().lower().split() + [None]) for k, t in docs]
    outside = {k: crc32(str("" if k is None else k).encode()) % 7 == 2 for k, _ in docs}
    c = Counter(w for k, ws in words if not outside[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (k, outside[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        for k, ws in words
    ]


def compare(rows, docs):
    want = sorted(expected(docs), key=str)
    got = sorted(rows, key=lambda r: str(tuple(r)[:5]))
    assert len(got) == len(want)
    for r, w in zip(got, sorted(want, key=lambda w: str(w[:5]))):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_query_and_the_tail(spark, monkeypatch):
    """Also with few broadcast words, so that most meet their counts in the join."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = queries.QUERIES["op10_lm_scoring"](spark, DATA).collect()
    compare(rows, docs)
    monkeypatch.setattr(lm, "BROADCAST", 500)
    again = {r.doc_id: r for r in queries.QUERIES["op10_lm_scoring"](spark, DATA).collect()}
    compare(again.values(), docs)
    assert all(math.isclose(r.score, again[r.doc_id].score, rel_tol=1e-3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_odd_documents(spark):
    rows = lm.score_documents(odd_documents(spark)).collect()
    assert len(rows) == len(ROWS)
    compare(rows, texts())
    assert lm.score_documents(no_documents(spark)).count() == 0


def test_the_network_knows_more_than_the_most_frequent_words(spark, monkeypatch):
    """A corpus of 2,000 equally frequent words is all in the vocabulary."""
    seen = []
    fit = lm._fit
    monkeypatch.setattr(lm, "_fit", lambda *a: seen.append(a[3]) or fit(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 4 * 500, i % 4 * 500 + 500))) for i in range(40)], "doc_id long, text string")
    out = lm.score_documents(docs).collect()
    assert len(seen[0]) == 2001
    assert len(out) == 40 and all(np.isfinite(r.score) and r.score < 0 for r in out)


def test_output_in_groups_of_classes(monkeypatch):
    """Words of few and of many classes against a plain softmax; scoring holds a bounded number of columns at once."""
    r = np.random.default_rng(8)
    m = Network.start(np.full(CLASSES * WORDS + 1, 1 / (CLASSES * WORDS + 1)))
    m.p["c"], m.p["w"] = (3 * r.normal(size=m.p[k].shape).astype(np.float32) for k in ("c", "w"))
    ids = np.r_[np.zeros(300, int), r.integers(0, CLASSES * WORDS + 1, 200), [CLASSES * WORDS] * 5, [CLASSES * WORDS - 1]]
    h = np.tanh(r.normal(size=(STATE, len(ids)))).astype(np.float32)

    def share(scores, at):
        return scores[at] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()

    def plain(word, state):
        c = word // WORDS
        inside = 0.0 if c == CLASSES else share(state @ m.p["w"][c].astype(float) + m.p["wb"][c], word % WORDS)
        return inside + share(state @ m.p["c"].astype(float) + m.p["cb"], c)

    wanted = [plain(w, s) for w, s in zip(ids, h.T.astype(float))]
    assert np.allclose(m.output(h, ids)[0], wanted, rtol=1e-4, atol=1e-4)
    m.p["c"], m.p["w"] = m.p["c"] * 40, m.p["w"] * 40  # scores whose exponentials leave the range of floats
    wanted = [plain(w, s) for w, s in zip(ids, h.T.astype(float))]
    assert np.allclose(m.output(h, ids)[0], wanted, rtol=1e-4, atol=1e-2)

    widths, output = [], Network.output
    monkeypatch.setattr(Network, "output", lambda self, h, ids, **more: (widths.append(len(ids)), output(self, h, ids, **more))[1])
    lm.score(m, [r.integers(0, CLASSES * WORDS, 20).astype(np.int32) for _ in range(2000)])
    assert max(widths) <= lm.WINDOW * lm.STREAMS and sum(widths) == 40_000


def test_words_of_many_texts_at_once(monkeypatch):
    """Cut, lower-cased and numbered as one by one, in parts of few bytes; no text, blanks and long texts included."""
    import pyarrow as pa

    some = [t for _, t in texts()] + ["", " ", "\x0b A\tb \r\n", "É é A", "x" * 500, "a\x1cb\x85c", " lead", "trail ", "a  b"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], names=["k", "t"])
    table = {w: i for i, w in enumerate([b"a", b"b", lm.END.encode(), b"lead"])}
    for cut in (1, 60, 1 << 23):
        monkeypatch.setattr(lm, "CUT", cut)
        parts = list(lm.parts_of(batch, 1))
        assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(len(some)))
        ids = [i.tolist() for p in parts for i in lm.ids_met(table, p.column(1))]
        assert ids == [lm.vocabulary_ids(table, lm.words_of(t)).tolist() for t in some]
        found = [w for p in parts for w in [lm.words_met(p.column(1))]]
        got = [w[0].take(pa.array(c)).to_pylist() for w in found for c in np.split(w[1], np.cumsum(w[2])[:-1])]
        assert got == [lm.words_of(t) for t in some]


def test_scoring_looks_up_a_word_once_for_many_texts(spark, monkeypatch):
    """Of texts that repeat their words, no text is cut by itself but those of the starting sample."""
    calls = spark.sparkContext.accumulator(0)
    plain = lm.words_of

    def counted(t):
        calls.add(1)
        return plain(t)

    monkeypatch.setattr(lm, "words_of", counted)
    monkeypatch.setattr(lm, "START_ROWS", 3)
    docs = spark.createDataFrame([(i, "a b c " * 5) for i in range(50)], "doc_id long, text string")
    assert lm.score_documents(docs).count() == 50
    assert calls.value <= 3
