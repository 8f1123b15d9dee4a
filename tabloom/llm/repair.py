"""Cheapest repair of conversations by an auction shortest-path algorithm.

A conversation is a lattice: a node is (row, state of the grammar ``(s?(ua)+)?``), an arc an edit
with an integer cost. The auction keeps a price for every node, never above the cost of an arc plus
the price at its head, and one path from the origin: where the path's last node has a price below all
of its arcs it is raised and the path contracts, else the path extends along the best arc. A path
that arrives proves the origin's price. Rows are taken in blocks from the end, so that prices proved
at a block's border serve the block before and work grows with the rows. With such prices every
cheapest repair runs over tight arcs alone; they are traced from the start, the least letter first.

* Null roles and texts are one space, as is a null turn in the text that damage is drawn by. Rows
  with a null conversation are left out. Conversations whose rows are all gone get zeros.
* Rows are in order of ``turn``, nulls first; equal turns by role, then by a digest of role and text.
  Repeated rows are rows of their own (and so duplicates). An empty role has a space for its initial.
* Places in a conversation come from a range-partitioned running count, and duplicates from a keyed
  join, so a long conversation is spread; its lattice needs one character a row, as its audit does,
  and its repaired text is hashed as a stream.
* Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from ..sources.shared import release, settle

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows of a block of the lattice.
BLOCK = 64
#: States: start, after system, after user, after assistant. The one role that may be inserted or given next:
NEXT = (2, 2, 3, 2)
#: State after keeping a row, by state and initial.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Blanks of a text.
BLANKS = " \t\n\x0b\x0c\r"
INITIALS, FAULTS = "sua ", ("", "truncated", "gone")
EMPTY = hashlib.sha256(b"").hexdigest()


def row_code(initial: str, fault: str) -> str:
    """One letter for what the lattice has to know of a row."""
    return chr(97 + 3 * INITIALS.index(initial if initial in INITIALS else " ") + FAULTS.index(fault))


ROWS = {row_code(i, f): (i, f) for i in INITIALS for f in FAULTS}


def edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that take a row."""
    initial, fault = ROWS[code]
    out = [("D", DELETE, state)]
    if fault != "gone":
        more = CUT if fault else 0
        if initial in KEPT[state]:
            out.append(("K", KEEP + more, KEPT[state][initial]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


ARCS = {(code, state): edits(code, state) for code in ROWS for state in range(4)}


def auction(prices: list[list[int]], codes: str, first: int, last: int, origin: int) -> None:
    """Raise prices until that of (first, origin) is the cost of the cheapest way to the proved prices at ``last``."""
    path = [(first, origin)]
    while path[-1][0] < last:
        row, state = path[-1]
        best, head = INSERT + prices[row][NEXT[state]], (row, NEXT[state])
        for _, cost, to in ARCS[codes[row], state]:
            if cost + prices[row + 1][to] < best:
                best, head = cost + prices[row + 1][to], (row + 1, to)
        if prices[row][state] < best:
            prices[row][state] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)


def settled_prices(codes: str) -> list[list[int]]:
    """Prices of all nodes; proved at the borders of blocks."""
    n = len(codes)
    # without rows left, what is missing is inserted
    prices = [[0, 2 * INSERT, INSERT, 0]]
    least = [min(cost for s in range(4) for _, cost, _ in ARCS[c, s]) for c in codes]
    prices = [[0] * 4 for _ in range(n)] + prices
    for last in range(n, 0, -BLOCK):
        first = max(last - BLOCK, 0)
        bound = min(prices[last])
        for row in range(last - 1, first - 1, -1):
            bound += least[row]
            prices[row] = [bound] * 4
        for origin in range(4):
            auction(prices, codes, first, last, origin)
    return prices


def tight_arcs(codes: str, prices: list[list[int]]) -> list[list[list[tuple[str, int, int]]]]:
    """(letter, row, state) of the tight arcs of each node over which the end is reached."""
    n = len(codes)
    out: list[list[list[tuple[str, int, int]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for row in range(n, -1, -1):
        for state in sorted(range(4), key=prices[row].__getitem__):
            price = prices[row][state]
            to = NEXT[state]
            if price == INSERT + prices[row][to] and (out[row][to] or (row == n and to in FINAL)):
                out[row][state].append(("I", row, to))
            if row < n:
                for letter, cost, to in ARCS[codes[row], state]:
                    if price == cost + prices[row + 1][to] and (out[row + 1][to] or (row + 1 == n and to in FINAL)):
                        out[row][state].append((letter, row + 1, to))
    return out


def repaired(codes: str) -> tuple[int, str, list[str]]:
    """(cost, audit, edits before and at each row and after the last).

    In the edits, ``u`` and ``a`` insert a role, ``U`` and ``A`` give it to the row, ``K`` keeps and ``D`` deletes.
    A letter fixes the next state, so the trace is one path.
    """
    prices = settled_prices(codes)
    tight = tight_arcs(codes, prices)
    row, state, audit, steps = 0, 0, [], [""] * (len(codes) + 1)
    while not (row == len(codes) and state in FINAL):
        letter, down, to = min(tight[row][state])
        audit.append(letter)
        role = "ua"[to - 2] if to >= 2 else "s"
        steps[row] += role if letter == "I" else role.upper() if letter == "R" else letter
        row, state = down, to
    return prices[0][0], "".join(audit), steps


def illegal_pairs(codes: str) -> int:
    initials = "".join(ROWS[c][0] for c in codes)
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows lost, emptied, cut, repeated or given a wrong role by a fixed draw."""
    rows = _plain(conversations)
    draw = F.crc32(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")
    ) % 20
    return rows.withColumn("draw", draw).where("draw <> 0").select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _plain(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, fault) for each row, in its place."""
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    tally = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", digest)
    placed = settle(
        running_totals(tally, ["turn", "role", "digest"], {"upto": "n"}, by=["conv_id"])
        .select("conv_id", "turn", "role", "text", "digest", "n", "upto"),
        "turns-placed",
    )
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("upto").alias("upto"), F.lit(True).alias("first"))
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    copy = F.col("upto") - F.col("n") + 1 + F.col("k")
    known = placed.join(firsts, ["conv_id", "digest", "upto"], "left").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k")
    )
    out = settle(
        known.select(
            "conv_id", "turn", "role", "text", copy.alias("pos"),
            F.when(shown == "", "blank").when(F.col("first").isNull() | (F.col("k") > 0), "duplicate")
            .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
        ),
        "turns-faults",
    )
    release(placed)
    return out


def _solved(codes: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, steps) of each conversation's row codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = lru_cache(maxsize=4096)(lambda c: (illegal_pairs(c), *repaired(c)))
        for batch in batches:
            found = [solve(c) if len(c) <= BLOCK else solve.__wrapped__(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.list_(pa.string())),
                ],
                names=["conv_id", "illegal", "cost", "audit", "steps"],
            )

    kind = codes.schema["conv_id"].dataType.simpleString()
    return codes.mapInArrow(run, f"conv_id {kind}, illegal long, cost long, audit string, steps array<string>")


def repaired_turns(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, pos, lines): what a repaired conversation says at each place; deleted rows are gone."""
    steps = solved.select("conv_id", F.posexplode("steps").alias("at", "step")).where("step NOT IN ('', 'D')")
    line = F.transform(
        F.split("step", ""),
        lambda c: F.when(c == "u", "user:").when(c == "a", "assistant:")
        .when(c == "K", F.concat(F.col("role"), F.lit(":"), F.col("text")))
        .when(c == "U", F.concat(F.lit("user:"), F.col("text")))
        .when(c == "A", F.concat(F.lit("assistant:"), F.col("text"))),
    )
    return (
        steps.withColumn("pos", F.col("at").cast("long") + 1)
        .join(rows.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"], "left")
        .select("conv_id", "pos", F.array_join(line, "\n").alias("lines"))
    )


def _hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): lines hashed as they come, none kept."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            ids, hashes = [], []
            for k, lines in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest is not None and k == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        ids.append(conv)
                        hashes.append(digest.hexdigest())
                    conv, digest = k, hashlib.sha256()
                digest.update(lines.encode("utf-8"))
            yield made(ids, hashes, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if digest is not None:
            yield made([conv], [digest.hexdigest()], last)

    def made(ids, hashes, key):
        return pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(
        run, f"conv_id {kind}, repaired_sha256 string"
    )


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``ids`` (default: those given): faults, cheapest edits, and a hash of the repair.

    A row's first fault counts: blank, duplicate (role and text seen before), truncated (no full stop,
    exclamation or question mark at its end). Edits: keep 0, rerole 2, delete 3 (a must for blank and
    duplicate rows), insert an empty turn 2; a truncated row that stays adds 1. The audit has the initials
    of the cheapest edits in order, the least of several.
    """
    faults = _faults(_plain(conversations))
    initial = F.when(F.col("role") == "", " ").otherwise(F.left("role", F.lit(1)))
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("fault") == "truncated", 1).when(F.col("fault") == "", 0).otherwise(2)
    spread = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = settle(
        faults.groupBy("conv_id").agg(
            F.coalesce(spread.try_cast("long"), F.lit(0)).alias("gaps"),
            *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("pos", F.char(97 + 3 * place + fault).alias("code")))),
                    lambda x: x["code"],
                ), "",
            ).alias("codes"),
        ),
        "turn-codes",
    )
    solved = settle(_solved(counts.select("conv_id", "codes")), "edits")
    hashes = _hashes(repaired_turns(faults, solved))
    every = (conversations if ids is None else ids).select("conv_id").where("conv_id IS NOT NULL").distinct()
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": EMPTY}
    return (
        every.join(counts.drop("codes"), "conv_id", "left").join(solved.drop("steps"), "conv_id", "left")
        .join(hashes, "conv_id", "left").fillna(none)
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    )
