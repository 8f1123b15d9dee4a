"""Language-model scores of whole documents with a gated recurrent network.

Counts of every word come from all training documents. The most frequent words form
the network's vocabulary, dealt to classes; every other word belongs to one last class,
inside which it has its smoothed share of that class's tokens. The network gives the
class and, inside a class of frequent words, the word: the probability of a word is the
product, so a step needs the scores of all classes and of one class's words only.

The network starts from the words' shares (then it is a unigram model) and learns by
truncated backpropagation: first on a bounded sample on the driver, to agree on a
start, then each partition goes over all its training documents, and the partitions'
networks are averaged by their tokens. Documents are scored whole: windows of a fixed
number of steps carry their state on to the next.

Counts are pre-aggregated before the shuffle. Words of the vocabulary are broadcast
(their number is fixed); the rest meet their counts in a join that holds a document's
rare words only, with the frequent ones among them, up to a fixed number, broadcast too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle
from .common import fold, whole_texts

#: Classes of frequent words and words in each; one class more holds all other words.
CLASSES = 64
WORDS = 64
#: Size of the state.
STATE = 8
#: Steps of a window, and streams trained side by side.
WINDOW = 16
STREAMS = 512
#: Classes that one product takes together, padded to the most columns among them: the frequent ones alone.
GROUPS = [slice(a, z) for a, z in zip((0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48), (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, CLASSES))]
#: Columns whose outputs are computed at once.
COLUMNS = WINDOW * STREAMS
#: Scores below this bound need no largest one taken off before the exponential.
BOUND = 80.0
#: Step size, and what Adagrad takes as already seen, so that first steps are no larger than later ones.
RATE = np.float32(0.1)
SETTLED = np.float32(1e-5)
#: Training documents that the starting network is fitted on at most.
START_ROWS = 400
#: Words whose counts are broadcast at most, the vocabulary among them, and their length in bytes.
BROADCAST = 200_000
LONGEST = 64
#: Tokens held by a scoring task at once.
HELD = 2_000_000
#: Bytes of the texts whose words are cut at once.
CUT = 1 << 23

END = "\n"  # no word: blanks cut words


def words_of(text: str) -> list[bytes]:
    """Words cut at the ASCII blanks, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def parts_of(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold a bounded number of bytes together (one longer text alone)."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + CUT, side="right")))
        yield batch.slice(low, high - low)
        low = high


def words_met(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place among them of each word, each text's number of words); words as ``words_of`` cuts them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    met = lists.flatten().dictionary_encode()
    codes = met.indices.to_numpy()
    blank = pc.binary_length(met.dictionary).to_numpy(zero_copy_only=False) == 0  # what stands beside outer blanks
    if blank.any():
        word = ~blank[codes]
        row = np.repeat(np.arange(len(counts)), counts)
        codes, counts = codes[word], np.bincount(row[word], minlength=len(counts))
    return met.dictionary.cast(pa.binary()), codes, counts


def ids_met(table: dict[bytes, int], texts: pa.Array) -> Iterator[np.ndarray]:
    """``vocabulary_ids`` of each text."""
    words, codes, counts = words_met(texts)
    *ids, end = vocabulary_ids(table, words.to_numpy(zero_copy_only=False).tolist())
    yield from with_ends(np.array(ids, np.int32)[codes], counts, end)


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> list[np.ndarray]:
    """The ids of each text, one after the other in ``ids``, with an end behind them."""
    stops = np.cumsum(counts)
    out = np.insert(ids, stops, end)
    return np.split(out, (stops + np.arange(1, len(stops) + 1))[:-1])


class Network:
    """Parameters of the recurrent network; ``p`` holds them by name."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, shares: np.ndarray, seed: int = 5) -> Network:
        """Random small weights; the output biases are the words' and classes' log shares."""
        r = np.random.default_rng(seed)
        vocabulary = CLASSES * WORDS
        by_class = shares[:vocabulary].reshape(CLASSES, WORDS)
        total = np.append(by_class.sum(axis=1), shares[vocabulary])
        inside = by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1e-30)
        p = {
            "x": r.normal(0, 0.3, (vocabulary + 2, 3 * STATE)),  # inputs: words, any other word, the start
            "h": r.normal(0, 0.3, (STATE, 3 * STATE)),
            "c": r.normal(0, 0.05, (STATE, CLASSES + 1)),
            "cb": np.log(np.maximum(total, 1e-9)),
            "w": r.normal(0, 0.05, (CLASSES, STATE, WORDS)),
            "wb": np.log(np.maximum(inside, 1e-9)),
        }
        p["x"][:, STATE : 2 * STATE] += 1.0  # remember by default
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    # States and gates are held with one row per unit and one column per stream, so that the gates are whole rows.

    def ready(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input table and recurrent matrices as the steps read them."""
        x, h = self.p["x"], self.p["h"]
        return (np.ascontiguousarray(x.T), np.ascontiguousarray(h[:, : 2 * STATE].T), np.ascontiguousarray(h[:, 2 * STATE :].T))

    @staticmethod
    def step(tables: tuple, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Next states after reading a word in each stream, and what backpropagation needs."""
        inputs, gate, candidate = tables
        x = inputs.take(ids, axis=1)
        g = gate @ h
        g += x[: 2 * STATE]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        reset, keep = g[:STATE], g[STATE:]
        rh = reset * h
        new = candidate @ rh
        new += x[2 * STATE :]
        np.tanh(new, out=new)
        return new + keep * (h - new), (ids, h, reset, keep, rh, new)

    def output(self, h: np.ndarray, ids: np.ndarray, learn: bool = True) -> tuple[np.ndarray, tuple]:
        """Natural log probability of the word in each column (of its class for a word of the last class).

        With ``learn`` also what backpropagation needs: the classes' and words' shares less the ones that were met.
        """
        p = self.p
        classes = np.minimum(ids // WORDS, CLASSES)
        share = p["c"].T @ h
        share += p["cb"][:, None]
        if (np.abs(p["c"]).sum(axis=0) + np.abs(p["cb"])).max() > BOUND:  # states lie between -1 and 1
            share -= share.max(axis=0)
        columns = np.arange(len(ids))
        out = share[classes, columns]
        np.exp(share, out=share)
        total = share.sum(axis=0)
        out -= np.log(total)
        if learn:
            share /= total
            share[classes, columns] -= 1
        inside = []
        order = np.argsort(classes.astype(np.uint16), kind="stable")  # short numbers are sorted by their digits
        counts = np.bincount(classes, minlength=CLASSES + 1)
        starts = np.cumsum(counts) - counts
        large = (np.abs(p["w"]).sum(axis=1) + np.abs(p["wb"])).max() > BOUND
        met, states = order[: starts[CLASSES]], h.take(order, axis=1)
        words, gain = ids[met] % WORDS, np.empty(len(met), h.dtype)
        for group in GROUPS:
            width = int(counts[group].max())
            if not width:
                continue
            if group.stop - group.start == 1:  # its columns lie side by side
                at = slice(starts[group.start], starts[group.start] + width)
                own, c, k, valid = states[None, :, at], np.zeros(1, int), np.arange(width), np.ones((1, 1), bool)
            else:
                rank = np.arange(width)
                valid = rank < counts[group][:, None]
                places = np.minimum(starts[group][:, None] + rank, len(ids) - 1)
                own = states.take(places.ravel(), axis=1).reshape(len(h), *places.shape).transpose(1, 0, 2)
                c, k = np.nonzero(valid)
                at = slice(starts[group.start], starts[group.start] + len(c))
            e = p["w"][group].transpose(0, 2, 1) @ own
            e += p["wb"][group][:, :, None]
            if large:
                e -= e.max(axis=1, keepdims=True)
            word = words[at]
            picked = e[c, word, k]
            np.exp(e, out=e)
            t = e.sum(axis=1)
            gain[at] = picked - np.log(t[c, k])
            if learn:
                e *= (valid / t).astype(e.dtype)[:, None]
                e[c, word, k] -= 1
                inside.append((group, c, k, at, e, own))
        out[met] += gain
        return out, (share, met, inside)

    def gradients(
        self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, h: np.ndarray, tokens: int
    ) -> tuple:
        """(gradients of the loss over ``tokens``, last state, loss) of one window of (step, stream) arrays."""
        p, caches, states, tables = self.p, [], [], self.ready()
        goes_on = (inputs != CLASSES * WORDS + 1).astype(h.dtype)  # a document starts without a state
        for t in range(len(inputs)):
            h, cache = self.step(tables, inputs[t], h * goes_on[t])
            caches.append(cache)
            states.append(h)
        used = np.flatnonzero(weight.reshape(-1))
        flat = np.concatenate(states, axis=1).take(used, axis=1)
        logp, (share, met, inside) = self.output(flat, targets.reshape(-1)[used])
        n = h.dtype.type(tokens)
        d = {k: np.zeros_like(v) for k, v in p.items()}
        d["c"] = flat @ share.T / n
        d["cb"] = share.sum(axis=1) / n
        back = p["c"] @ share
        more = np.empty((STATE, len(met)), h.dtype)
        for group, c, k, at, e, own in inside:
            d["w"][group] = own @ e.transpose(0, 2, 1) / n
            d["wb"][group] = e.sum(axis=2) / n
            of_states = p["w"][group] @ e
            more[:, at] = of_states[0] if len(of_states) == 1 else of_states.transpose(1, 0, 2)[:, c, k]
        back[:, met] += more
        dh_all = np.zeros((STATE, weight.size), h.dtype)
        dh_all[:, used] = back / n
        width = weight.shape[1]
        dh = np.zeros_like(h)
        gate, candidate = (np.ascontiguousarray(m) for m in (p["h"][:, : 2 * STATE], p["h"][:, 2 * STATE :]))
        d_gate, d_candidate = np.zeros_like(gate), np.zeros_like(candidate)
        changes = np.empty((3 * STATE, weight.size), h.dtype)
        for t in range(len(inputs) - 1, -1, -1):
            _, before, reset, keep, rh, new = caches[t]
            dh += dh_all[:, t * width : (t + 1) * width]
            change = changes[:, t * width : (t + 1) * width]
            dkeep = dh * keep
            dnew = (dh - dkeep) * (1 - new * new)
            drh = candidate @ dnew
            change[:STATE] = drh * rh * (1 - reset)
            change[STATE : 2 * STATE] = dkeep * (before - new) * (1 - keep)
            change[2 * STATE :] = dnew
            gates = np.ascontiguousarray(change[: 2 * STATE])
            d_gate += before @ gates.T
            d_candidate += rh @ dnew.T
            dkeep += drh * reset
            dkeep += gate @ gates
            dh = dkeep * goes_on[t]
        d["h"] = np.concatenate([d_gate, d_candidate], axis=1)
        ids = inputs.reshape(-1)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        d["x"][ids[first]] = np.add.reduceat(changes.take(order, axis=1), first, axis=1).T
        return d, h, -float(logp.sum())


def vocabulary_ids(table: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """Ids of a document's words and its end; every other word has the id after the vocabulary's."""
    other = CLASSES * WORDS
    return np.fromiter(map(table.get, [*words, END.encode()], repeat(other)), np.int32, len(words) + 1)


def train(network: Network, documents: Iterator[np.ndarray], streams: int = STREAMS) -> tuple[Network, int]:
    """One pass over the documents with scaled steps (Adagrad); returns the network and the tokens seen.

    Each stream reads documents one after the other; its state starts anew with each and
    is carried from window to window. Streams that run dry are dropped; a window that is
    not full counts for as much less, so the last long documents don't drown the others.
    """
    start = np.int32(CLASSES * WORDS + 1)
    memory = {k: np.full_like(v, SETTLED) for k, v in network.p.items()}
    held: list[np.ndarray] = [np.empty(0, np.int32)] * streams  # each document's ids behind a start
    h = np.zeros((STATE, streams), np.float32)
    seen, more = 0, True
    while True:
        for s in range(len(held)):
            while more and len(held[s]) <= WINDOW:
                ids = next(documents, None)
                if ids is None:
                    more = False
                    break
                held[s] = np.concatenate([held[s], [start], ids])
        full = [s for s in range(len(held)) if len(held[s]) > 1]
        if not full:
            return network, seen
        if len(full) < len(held):
            held, h = [held[s] for s in full], h[:, full]
        block = np.full((WINDOW + 1, len(held)), -1, np.int32)
        for s, ids in enumerate(held):
            part = ids[: WINDOW + 1]
            block[: len(part), s] = part
            held[s] = ids[WINDOW:]
        inputs, targets = np.maximum(block[:-1], 0), block[1:]
        weight = (targets >= 0) & (targets != start)
        d, h, _ = network.gradients(inputs, targets, weight, h, WINDOW * streams)
        size = np.sqrt(sum(float((g**2).sum()) for g in d.values()))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        for k, g in d.items():
            g *= scale
            memory[k] += g**2
            g *= RATE
            g /= np.sqrt(memory[k])
            network.p[k] -= g
        seen += int(weight.sum())


def score(network: Network, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each document; of words of the last class only their class counts."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lengths = np.array([len(documents[i]) for i in order], np.int64)
    flat = np.concatenate([documents[i] for i in order]) if order else np.empty(0, np.int32)
    begins = np.cumsum(lengths) - lengths
    out = np.zeros(len(documents))
    h = np.zeros((STATE, len(documents)), np.float32)
    last = np.full(len(documents), CLASSES * WORDS + 1, np.int32)
    tables = network.ready()
    at = 0
    while len(lengths) and at < lengths[0]:
        active = int(np.searchsorted(-lengths, -at, side="left"))  # documents longer than ``at``
        width = min(WINDOW, int(lengths[0]) - at)
        places = at + np.arange(width)[:, None]
        block = flat.take(np.minimum(begins[:active] + places, len(flat) - 1))
        block[places >= lengths[:active]] = -1
        states, state = [], np.ascontiguousarray(h[:, :active])
        before = last[:active]
        for t in range(width):
            state, _ = network.step(tables, before, state)
            states.append(state)
            before = np.maximum(block[t], 0)
        h[:, :active], last[:active] = state, before
        here = np.flatnonzero(block.reshape(-1) >= 0)
        met, words = np.concatenate(states, axis=1).take(here, axis=1), block.reshape(-1)[here]
        for low in range(0, len(here), COLUMNS):
            part = slice(low, low + COLUMNS)
            logp, _ = network.output(met[:, part], words[part], learn=False)
            out[:active] += np.bincount(here[part] % active, logp.astype(np.float64), active)
        at += width
    back = np.empty(len(documents))
    back[order] = out
    return back


def _word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, c) over all texts, the end of each text included; counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"]
            )
            seen.clear()
            return batch

        for batch in batches:
            for part in parts_of(batch, 0):
                words, codes, counts = words_met(part.column(0))
                times = np.bincount(codes, minlength=len(words)).tolist()
                seen.update(dict(zip(words.to_numpy(zero_copy_only=False).tolist(), times)))
                seen[END.encode()] += len(counts)
                seen.pop(b"", None)
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    return texts.select(text).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _fit(texts: DataFrame, text: str, key: str, table: dict[bytes, int], shares: np.ndarray) -> Network:
    """The starting network from a bounded sample, then one pass of every partition over its training texts."""
    spark = texts.sparkSession
    start_rows = texts.orderBy(F.xxhash64(F.lit(23), F.col(f"`{key}`")), key).limit(START_ROWS)
    shared_table = spark.sparkContext.broadcast(table)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary_ids(shared_table.value, words_of(t)).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    sample = sorted(bytes(r.ids) for r in start_rows.select(text).mapInArrow(ids, "ids binary").toLocalIterator())
    first = Network.start(shares)
    rows = [np.frombuffer(s, np.int32) for s in sample]
    for _ in range(2):
        first, _ = train(first, iter(rows), 64)
    names = list(first.p)
    shared = spark.sparkContext.broadcast([first.p[n] for n in names])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[np.ndarray]:
            for batch in batches:
                for part in parts_of(batch, 0):
                    yield from ids_met(shared_table.value, part.column(0))

        network, seen = train(Network({n: v.copy() for n, v in zip(names, shared.value)}), documents())
        if seen:
            flat = np.concatenate([network.p[n].ravel() for n in names]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "weights"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0
        for batch in batches:
            for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.frombuffer(w)
                total = w.copy() if total is None else total + w
                seen += n
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"]
            )

    kind = "n long, weights binary"
    parts = texts.select(text).mapInArrow(local, kind)
    parts = parts.repartition(16).mapInArrow(add, kind)  # the networks of many partitions are added up in two steps
    total, seen = None, 0
    for r in parts.toLocalIterator():
        w = np.frombuffer(bytes(r.weights))
        total = w if total is None else total + w
        seen += r.n
    if not seen:
        return first
    flat, at, out = total / seen, 0, {}
    for n in names:
        size = first.p[n].size
        out[n] = flat[at : at + size].reshape(first.p[n].shape).astype(np.float32)
        at += size
    return Network(out)


def score_documents(
    df: DataFrame, folds: int = 7, held_out: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are words cut at ASCII blanks, A-Z lower-cased, and one end. Training texts
    are those whose crc32 remainder is not ``held_out``. ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)) over the tokens, with the token's count c, all N tokens
    and V distinct ones in the training texts; ``n_known`` counts tokens with c > 0.
    ``score`` is the network's log10 probability of the text.

    A null text is empty and scored for its end alone. Null keys belong to the fold of
    the empty text. Repeated rows are scored one by one; other columns are ignored; an
    empty table gives an empty result. Without training texts N and V are 0.
    """
    spark = df.sparkSession
    texts = whole_texts(df, key, text).withColumn("held_out", fold(key, folds) == held_out)
    training = texts.where(~F.col("held_out"))
    counts = settle(_word_counts(training, text), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = END.encode()
    short = counts.where((F.col("word") != F.lit(end)) & (F.length("word") <= LONGEST))
    # the least count that at most BROADCAST words reach, so that no task sends more words than are taken
    room, least = BROADCAST, None
    for r in short.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(BROADCAST).collect():
        room -= r.words
        if room < 0:
            break
        least = r.c
    top = short.where(F.col("c") >= least).collect() if least is not None else []
    size = CLASSES * WORDS
    top += short.orderBy(F.desc("c"), "word").limit(size).collect()  # the vocabulary, however few words are broadcast
    of_end = counts.where(F.col("word") == F.lit(end)).first()
    known = {end: of_end.c if of_end else 0} | {bytes(r.word): r.c for r in top}
    table = {w: i for i, w in enumerate(sorted(known, key=lambda w: (-known[w], w))[:size])}
    if end not in table:
        table[end] = table.pop(min(table, key=lambda w: (known[w], w)))
    held = np.zeros(size + 1)
    for w, i in table.items():
        held[i] = known[w] + 1
    rest = total - int(held[:size].sum() - len(table)), distinct - sum(known[w] > 0 for w in table)
    held[size] = rest[0] + rest[1] + 1
    network = _fit(training, text, key, table, held / held.sum())

    names = list(network.p)
    shared = spark.sparkContext.broadcast((table, known, [network.p[n] for n in names]))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, weights = shared.value
        network = Network(dict(zip(names, weights)))
        index = dict(table)  # the vocabulary's ids, then those of the other words with a known count
        for w in known:
            index.setdefault(w, len(index))
        counts = np.array([known[w] for w in sorted(index, key=index.get)])
        logs, occurs, inner = np.log10(counts + 1.0), counts > 0, len(table)
        other, last = np.int32(CLASSES * WORDS), table[end]

        def counted(part: pa.RecordBatch) -> tuple[list[np.ndarray], list[pa.Array], list[pa.Array]]:
            """(ids of each text, the columns before its score, those after it)."""
            words, codes, counts = words_met(part.column(1))
            at = np.fromiter(map(index.get, words.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int32, len(words))
            unknown, outer = at < 0, at >= inner
            log, n = np.where(unknown, 0.0, logs[at]), len(counts)
            row, full = np.repeat(np.arange(n), counts), np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]

            def summed(of_word: np.ndarray) -> np.ndarray:
                """Sum over each text, added in pairs, as that of a long text needs."""
                out = np.zeros(n)
                out[full] = np.add.reduceat(of_word[codes].astype(np.float64), starts) if len(full) else 0.0
                return out

            known_tokens = summed(~unknown & occurs[at]).astype(np.int64) + int(occurs[last])
            tails = summed(unknown | outer).astype(np.int64)
            rare = np.flatnonzero(unknown[codes])
            pairs, times = np.unique(row[rare] * len(words) + codes[rare], return_counts=True)
            size = max(len(words), 1)
            places = np.searchsorted(pairs, np.arange(n + 1) * size).astype(np.int32)
            unseen = pa.MapArray.from_arrays(pa.array(places), words.take(pa.array(pairs % size)), pa.array(times.astype(np.int64)))
            return (
                with_ends(np.where(unknown | outer, other, at)[codes], counts, last),
                [part.column(0), part.column(2), pa.array(counts + 1), pa.array(known_tokens), pa.array(summed(log) + logs[last])],
                [pa.array(tails), unseen, pa.array(summed(np.where(outer, log, 0.0)))],
            )

        def flush(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
            scores = score(network, [i for ids, _, _ in waiting for i in ids]) / np.log(10)
            at = 0
            for ids, before, after in waiting:
                own = pa.array(scores[at : at + len(ids)])
                at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [*before, own, *after],
                    names=[key, "held_out", "n_tokens", "known", "base", "score", "tail", "rare", "tail_base"],
                )

        waiting: list[tuple] = []
        for batch in batches:
            for part in parts_of(batch, 1):
                waiting.append(counted(part))
                if sum(len(i) for ids, _, _ in waiting for i in ids) >= HELD:
                    yield from flush(waiting)
                    waiting = []
        if waiting:
            yield from flush(waiting)

    schema = (
        f"`{key}` {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail long, "
        "rare map<binary,bigint>, tail_base double"
    )
    scored = settle(
        texts.select(key, text, "held_out").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    # rare words: each document's are summed up once their counts are known
    rare = scored.select("row", F.explode("rare").alias("word", "n")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 1.0)).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    whole, tail = F.log10(F.lit(float(total + distinct + 1))), F.log10(F.lit(float(held[size])))
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").select(
        key, "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + F.col("tail_base") + rare_base - F.col("tail") * tail).alias("score"),
    )
