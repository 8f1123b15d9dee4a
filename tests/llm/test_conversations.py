"""Prefix trie and repair of conversations: SQL on odd tables, and brute force for their parts."""

import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import conversation_sql, prefix_trie, repair

from .edges import same

SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows(seed=1):
    """Ties, null turns, roles, texts and ids, repeated rows, shared starts, a long and a huge-text conversation."""
    r = random.Random(seed)
    says = ["Hello there.", "What is it?", "It is", "Yes!", "", " \t", "Go on.", None]
    rows = []
    for c in range(60):
        for turn in range(r.randint(0, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((c, r.choice([turn, turn, turn, None, 3]), role, r.choice(says)))
    rows += [(100 + k, t, ("user", "assistant")[t % 2], f"Same {t}.") for k in range(40) for t in range(3 + k % 4)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"Long {t}" + ".!"[t % 2 :]) for t in range(300)]
    rows += [(301, 0, "user", "word " * 20_000 + "end."), (-3, 0, "user", "Below zero."), (-5, 1, "user", "Base below.")]
    rows += [(None, 0, "user", "nobody's."), rows[0], rows[0], rows[5]]
    return rows


def expected(rows, sql):
    con = duckdb.connect()
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    con.register("conversations", pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "text"]))
    relation = con.sql(sql)
    return relation.columns, relation.fetchall()


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("path", "size", "key", "draw", "fault", "n", "digest"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.mark.parametrize("shards", [1, 13])
def test_trie_of_odd_rows(spark, shards):
    rows = odd_rows()
    columns, want = expected(rows, conversation_sql.TRIE)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        got = prefix_trie.prefix_trie(table(spark, rows), rebuild=True).select(*columns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    same(got, want)


def test_trie_without_rebuilding(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "bb"), (2, 0, "user", "a"), (2, 1, "user", "ccc"), (3, 0, "user", "a")]
    got = prefix_trie.prefix_trie(table(spark, rows)).collect()
    facts = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got}
    assert facts == {
        (0, 1): (None, 3, 1, 2, 2), (1, 1): (1, 3, 2, 2, 2), (2, 1): (1, 1, 0, 1, 0), (2, 2): (1, 1, 0, 1, 0),
    }


def test_no_conversations(spark):
    none = table(spark, [(1, 0, "user", "a")]).where("false")
    assert prefix_trie.prefix_trie(none, rebuild=True).collect() == []
    assert repair.repair_conversations(repair.damage(none), ids=none).collect() == []


def test_findclose():
    r = random.Random(2)
    for size in (1, 3, 700, 3000):
        bits, depth = [1], 1
        while len(bits) < 2 * size - depth:
            up = depth == 1 or r.random() < 0.52
            bits.append(int(up))
            depth += 1 if up else -1
        bits += [0] * depth
        tree = prefix_trie.Parentheses(np.array(bits, np.uint8))
        stack, want = [], {}
        for at, b in enumerate(bits):
            if b:
                stack.append(at)
            else:
                want[stack.pop()] = at
        assert {int(p): tree.findclose(int(p)) for p in tree.opens} == want


def test_repair_of_odd_rows(spark):
    rows = odd_rows()
    columns, want = expected(rows, conversation_sql.REPAIR)
    df = table(spark, rows)
    same(repair.repair_conversations(repair.damage(df), ids=df).select(*columns).collect(), want)


def cheapest(codes):
    """(cost, audit) by trying all edits of short conversations, with up to two insertions at a place."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(codes) + 1):
        for letters in itertools.product("DKR", repeat=len(codes)):
            state, cost, audit, good = 0, 0, "", True
            for row in range(len(codes) + 1):
                for _ in range(inserts[row]):
                    state, cost, audit = repair.NEXT[state], cost + 2, audit + "I"
                if row < len(codes):
                    to = {e[0]: e for e in repair.edits(codes[row], state)}.get(letters[row])
                    if to is None:
                        good = False
                        break
                    state, cost, audit = to[2], cost + to[1], audit + letters[row]
            if good and state in repair.FINAL:
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_repair_against_all_edits():
    r = random.Random(3)
    for _ in range(120):
        codes = "".join(r.choice(list(repair.ROWS)) for _ in range(r.randint(0, 4)))
        assert repair.repaired(codes)[:2] == cheapest(codes)


def plain(codes):
    """(cost, audit) by dynamic programming from the end."""
    after = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for code in reversed(codes):
        now = {s: min((c + after[t][0], letter + after[t][1]) for letter, c, t in repair.edits(code, s)) for s in range(4)}
        for _ in range(3):
            now = {s: min(now[s], (2 + now[repair.NEXT[s]][0], "I" + now[repair.NEXT[s]][1])) for s in range(4)}
        after = now
    return after[0]


def test_long_repairs_over_blocks():
    r = random.Random(5)
    for size in (63, 64, 65, 400, 1500):
        for pool in (list(repair.ROWS), [repair.row_code(i, "") for i in "sua"], [repair.row_code("u", "")]):
            codes = "".join(r.choice(pool) for _ in range(size))
            assert repair.repaired(codes)[:2] == plain(codes)


def test_prices_are_feasible_and_proved_at_borders():
    r = random.Random(6)
    codes = "".join(r.choice(list(repair.ROWS)) for _ in range(200))
    prices = repair.settled_prices(codes)
    for row, code in enumerate(codes):
        for state in range(4):
            assert prices[row][state] <= 2 + prices[row][repair.NEXT[state]]
            assert all(prices[row][state] <= cost + prices[row + 1][to] for _, cost, to in repair.edits(code, state))
    border = len(codes) - repair.BLOCK
    assert prices[border][0] == plain(codes[border:])[0]


def test_damage_is_as_stated(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)]
    got = repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got} == {"One. Two! Three?", "One Two Three", ""} and {r.role for r in got} == {"assistant", "user"}
    from collections import Counter
    from zlib import crc32

    times = Counter((r.conv_id, r.turn) for r in got)
    assert all(times[c, t] == {0: 0, 3: 2}.get(crc32(f"{c}:{t}".encode()) % 20, 1) for c, t, *_ in rows)
