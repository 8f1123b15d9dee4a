"""Exact order statistics, global ranks and running totals without a one-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ref
from ..functions.parsing import clean_number
from ..sources.shared import settle

SMALL_ROWS = 200_000
COLUMNS_AT_ONCE = 16
GRID = 1000


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: Sequence[float],
    small_rows: int = SMALL_ROWS,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of several expressions.

    Up to ``small_rows`` values one ``percentile`` aggregate is enough. Its state
    grows with the distinct values, so larger columns are narrowed instead: each
    pass counts the rows on both sides of a bracket and asks for an approximate
    grid inside it, until the bracket holds few rows or a single value.
    """
    cleaned = {k: clean_number(c) for k, c in values.items()}
    names = list(cleaned)
    head = df.select(*[c.alias(f"v{i}") for i, c in enumerate(cleaned.values())])
    counts = head.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(names))]).first()
    out: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in names}
    small = [i for i in range(len(names)) if 0 < counts[i] <= small_rows]
    large = [i for i in range(len(names)) if counts[i] > small_rows]
    if small:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        for start in range(0, len(small), COLUMNS_AT_ONCE):
            some = small[start : start + COLUMNS_AT_ONCE]
            row = head.agg(*[F.percentile(f"v{i}", probs).alias(f"v{i}") for i in some]).first()
            for slot, i in enumerate(some):
                out[names[i]] = list(row[slot])
    if large:
        wanted = {}
        for i in large:
            for p in probabilities:
                spot = p * (counts[i] - 1)
                wanted[(i, math.floor(spot))] = wanted[(i, math.ceil(spot))] = None
        found = _order_statistics(head, list(wanted), small_rows)
        for i in large:
            for slot, p in enumerate(probabilities):
                spot = p * (counts[i] - 1)
                low, high = found[(i, math.floor(spot))], found[(i, math.ceil(spot))]
                out[names[i]][slot] = low + (high - low) * (spot - math.floor(spot))
    return out


def _order_statistics(
    head: DataFrame, targets: list[tuple[int, int]], small_rows: int
) -> dict[tuple[int, int], float]:
    """Value at each (column, zero-based rank) by narrowing open brackets."""
    bracket = {t: (-math.inf, math.inf) for t in targets}
    outer = dict(bracket)
    found: dict[tuple[int, int], float] = {}
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    while len(found) < len(targets):
        open_targets = [t for t in targets if t not in found]
        spans = sorted({(t[0], *bracket[t]) for t in open_targets})
        aggregates = []
        for s, (i, a, b) in enumerate(spans):
            v = F.col(f"v{i}")
            inside = F.when((v > a) & (v < b), v)
            aggregates += [
                F.count_if(v < a).alias(f"lt{s}"),
                F.count_if(v == a).alias(f"at{s}"),
                F.count(inside).alias(f"in{s}"),
                F.count_if(v == b).alias(f"end{s}"),
                F.percentile_approx(inside, grid, GRID * 10).alias(f"grid{s}"),
            ]
        row = head.agg(*aggregates).first()
        narrow = []
        for t in open_targets:
            a, b = bracket[t]
            s = spans.index((t[0], a, b))
            rank = t[1] - row[f"lt{s}"]
            if rank < 0:
                bracket[t] = (outer[t][0], a)
            elif rank < row[f"at{s}"]:
                found[t] = a
            elif (rank := rank - row[f"at{s}"]) < row[f"in{s}"]:
                if row[f"in{s}"] <= small_rows:
                    narrow.append((t, a, b, rank))
                    continue
                marks = row[f"grid{s}"]
                cell = int(rank / row[f"in{s}"] * GRID)
                low, high = marks[max(cell - 2, 0)], marks[min(cell + 3, GRID)]
                outer[t] = (a, b)
                bracket[t] = (low if cell > 2 else a, high if cell < GRID - 3 else b)
                if low == high:
                    bracket[t] = (low, b)
            elif rank - row[f"in{s}"] < row[f"end{s}"]:
                found[t] = b
            else:
                bracket[t] = (b, outer[t][1])
        if narrow:
            # each list is bounded: its bracket was counted to hold at most small_rows rows
            row = head.agg(
                *[
                    F.element_at(
                        F.array_sort(
                            F.collect_list(
                                F.when((F.col(f"v{t[0]}") > a) & (F.col(f"v{t[0]}") < b), F.col(f"v{t[0]}"))
                            )
                        ),
                        F.lit(rank + 1),
                    ).alias(f"r{s}")
                    for s, (t, a, b, rank) in enumerate(narrow)
                ]
            ).first()
            for s, (t, *_rest) in enumerate(narrow):
                found[t] = row[f"r{s}"]
    return found


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    small_rows: int = 100_000,
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums over a global (or per ``by``) ordering.

    ``df`` must hold one row per (by, order). Small tables use a plain window.
    Larger ones are range-partitioned and settled; each range sums its own rows and
    starts from the totals of the ranges before it, so no task sees the whole order.
    """
    keys = [ref(c).desc() if descending else ref(c).asc() for c in order]

    def window(*parts: str) -> Column:
        spec = Window.partitionBy(*parts).orderBy(*keys)
        return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    if df.limit(small_rows + 1).count() <= small_rows:
        spec = window(*by)
        return df.select("*", *[F.sum(ref(c)).over(spec).alias(n) for n, c in sums.items()])
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        df.repartitionByRange(ranges, *[ref(c) for c in by], *keys).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    totals = placed.groupBy("_range", *by).agg(
        *[F.sum(ref(c)).alias(f"_t_{n}") for n, c in sums.items()]
    )
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        *by,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
    )
    spec = window("_range", *by)
    inner = placed.select("*", *[F.sum(ref(c)).over(spec).alias(n) for n, c in sums.items()])
    return inner.join(starts, ["_range", *by]).select(
        *[ref(c) for c in df.columns],
        *[(F.col(f"_s_{n}") + F.col(n)).alias(n) for n in sums],
    )
