"""The conversation trie against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cadence.llm import trie
from cadence.llm.entry import QUERIES


def brute(rows):
    """``(conv_id, depth, parent, n, children, leaves, saved, sha)`` of every node; ``rows``: conv_id, turn, role, text, the order of equal turns as given."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        b = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(b, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    sums = {}
    for s in sorted(members, key=len, reverse=True):
        own_tokens = (len(members[s]) - 1) * len(s[-1][1]) if s else 0
        sums[s] = ((0 if kids[s] else 1) + sum(sums[k][0] for k in kids[s]), own_tokens + sum(sums[k][1] for k in kids[s]))
    out = []
    for s, m in members.items():
        ends = sorted(c for c in m if built[c] == s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), *sums[s], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


def frame(spark, rows):
    """With columns whose names clash with those the operator uses."""
    ddl = "conv_id long, turn long, role string, text string, base int, band string, depth int, conv int, chars string"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], ddl).repartition(3)


def test_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, small)) == brute(rows)


def test_sql(spark, small):
    """The given SQL, on the table, against brute force."""
    import duckdb

    from cadence.llm.entry import ORACLE_SQL

    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    rows = db.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(db.sql(ORACLE_SQL["op13_prefix_trie"]).fetchall(), key=str) == brute(rows)


def test_random(spark):
    g = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 60), *range(101, 140), 300, 317, 318, -5, -120, -203, 7_000_000_001]:
        for t in range(int(g.integers(1, 9))):
            rows.append((c, None if t == 0 and c % 3 else t, ["user", "bot", None][int(g.integers(0, 3))], ["a", "bb", "", None, "é" * 3][int(g.integers(0, 5))]))
    rows.append((None, 0, "user", "nobody's"))
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_no_rows(spark):
    assert trie.prefix_trie(frame(spark, [])).count() == 0
    assert trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    one = [(4, 0, None, None)]
    assert got(trie.prefix_trie(frame(spark, one))) == brute(one)


def test_repeated_rows_are_turns(spark):
    rows = [(1, 1, "user", "same")] * 4 + [(2, 1, "user", "same")] * 7 + [(200, None, None, "")] * 3
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("band", [6, 7, 11])
def test_long_conversations_in_bands(spark, band):
    """Equal, diverging and shifted long conversations, over several ranges, stretches and bands."""
    long_ = [("user", f"t{k % 5}" * (k % 3)) for k in range(40)]
    rows = []
    for c in [100, 101, 102, 103, 205, 206, 207, 208, 301, 302]:
        turns = long_ if c % 2 else long_[:30] + [("bot", f"own {c}")]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(200, 0, "user", "one turn only")] + [(400, t, "user", "x" * t) for t in range(3)] + [(400 + k, t, *x) for k in range(1, 8) for t, x in enumerate(long_[: 10 + k // 3])]
    assert got(trie.prefix_trie(frame(spark, rows), band=band)) == brute(rows)
    deep = [(600 + k, t, "user", "same") for k in range(9) for t in range(25 + k % 3)]  # shifted members meet on the same nodes
    deep = [r for r in deep if r[0] != 600] + [(600, t, "user", "same") for t in range(2)]
    assert got(trie.prefix_trie(frame(spark, deep), band=band)) == brute(deep)


def test_a_hot_conversation_is_carried_over_ranges(spark):
    rows = [(9, t, "user", "w" * (t % 4)) for t in range(3000)] + [(c, 0, "user", "hello") for c in range(20, 60)]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "long " * 400_000), (2, 0, "user", "long " * 400_000), (3, 0, "user", "short")]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)
