"""Token counts by a two-tier lookup of pre-token lengths on the map side.

Tier one is a compact table of the most frequent pre-tokens of all texts and their
lengths, broadcast to every worker. Tier two is each worker's own cache: what tier one
does not hold is encoded once and kept. Counting the frequencies shuffles one number
for each distinct pre-token of a task; texts and their pre-tokens are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, settle
from .common import map_texts, vocabulary, whole_texts, worker_table
from .pretokens import LONGEST, PretokenTable, blocks

#: Pre-tokens that are broadcast, at most; they decide what is looked up where, never a count.
FREQUENT = 50_000
#: Characters whose words are counted at once, and distinct pre-tokens after which a task hands on its counts.
RUN = 1 << 23
PARTIAL = 200_000


def piece_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, n) of every pre-token in the whole column ``text``; those no table keeps or that hold a NUL are left out."""

    def count(batches):
        import pyarrow as pa

        table = worker_table(("counts", tokenizer), lambda: PretokenTable(vocabulary(tokenizer), len, sum))
        seen: Counter = Counter()
        for block in blocks(chain.from_iterable(b.column(0).to_pylist() for b in batches), RUN):
            for p, n in table.count_pieces(block).items():
                if len(p) <= LONGEST and "\0" not in p:
                    seen[p] += n
            if len(seen) > PARTIAL:
                yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())})

    return texts.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_pieces(texts: DataFrame, tokenizer: str) -> tuple[str, bytes]:
    """The most frequent pre-tokens, joined by NUL, and their lengths in tokens, one byte each.

    All texts are counted. Pieces that share the last place's count are in the table together or not at all.
    """
    counts = settle(piece_counts(texts, tokenizer), "pieces")
    least, held = None, 0
    # far fewer rows than pieces: the sum of k different counts is at least k * k / 2
    for r in counts.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.desc("n")).collect():
        if held + r.pieces > FREQUENT:
            break
        least, held = r.n, held + r.pieces
    pieces = sorted(r.piece for r in counts.where(F.col("n") >= least).select("piece").collect()) if held else []
    release(counts)
    table = PretokenTable(vocabulary(tokenizer), len, sum)
    table.of_pieces(pieces)
    lengths = np.array([table.pieces[p] for p in pieces], np.uint8)  # no longer than their bytes
    return "\0".join(pieces), lengths.tobytes()


def count_tokens(
    df: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    A null text is empty and has no tokens. Rows with a null or repeated key are counted
    like any other, one row out for each row in; other columns are ignored. An empty
    table gives an empty result.
    """
    texts = whole_texts(df, key, text).withColumnRenamed(text, "text")
    shared = df.sparkSession.sparkContext.broadcast(frequent_pieces(texts, tokenizer))

    def make():
        pieces, lengths = shared.value
        frequent = dict(zip(pieces.split("\0"), lengths)) if pieces else {}
        table = counting_table(tokenizer, frequent)

        def work(batch: list[str]) -> list:
            out: list[int] = []
            for block in blocks(batch):
                out += table.of_texts(block)
            return [np.array(out, np.int64)]

        return work

    sized = texts.select(key, F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return map_texts(sized, make, "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def counting_table(tokenizer: str, frequent: dict) -> PretokenTable:
    """The worker's own table, kept from task to task while the frequent pieces are the same."""
    kept = worker_table(("lengths", tokenizer), dict)
    if not kept or kept["table"].frequent.keys() != frequent.keys():
        kept["table"] = PretokenTable(vocabulary(tokenizer), len, sum, frequent)
    return kept["table"]
