import hashlib
import zlib

import duckdb
import pytest

from lexloom.llm import prefix_trie, queries

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """A trie of nested tuples, one conversation after the other."""
    by = {}
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(ts)] for c, ts in by.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(x for x, _ in below) or 1, own_saved + sum(x for _, x in below))
    out = []
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c, e in ms if e)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in ms), len(p), parent, len(ms), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(repr, map(tuple, df.collect())))


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(queries.op13_prefix_trie(spark, SF))
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(repr, con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op13_prefix_trie']})").fetchall())) == got


def same_start(c, n, tail):
    return [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(n)] + tail


ODD = [
    *same_start(0, 9, []), *same_start(1, 9, []), *same_start(2, 9, [(2, 9, "user", "on")]), *same_start(3, 7, [(3, 7, "user", "other")]),
    (4, None, "user", "turn 0"), (4, None, None, None), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"),
    (5, 0, "user", None), (101, 0, "user", "no base"), (102, 0, "x:", "a"), (103, 0, "x", ":a"), (-4, 0, "user", "turn 0"), (-250, 1, "user", "é" * 100_000), (-251, 1, "user", "é"),
    (None, 0, "user", "nobody's"), (900, 0, "user", "x"), (905, 3, "user", "x"),
]


@pytest.mark.parametrize("parts", [2, 50])
def test_odd_rows(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = spark.createDataFrame([(*r, 1, 2) for r in ODD], "conv_id long, turn long, role string, text string, depth long, pos long").repartition(7)
        assert found(prefix_trie.prefix_trie(turns)) == brute(ODD)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([], schema))) == []
    for rows in ([(7, 0, "user", "a")], [(100, 0, "user", "a"), (100, 1, "user", "b")], [(104, i, "user", "a") for i in range(3)], [(c, 0, "user", "same") for c in range(300)]):
        assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema))) == brute(rows)
