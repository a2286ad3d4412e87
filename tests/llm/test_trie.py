import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import skew, trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, digest string, ka string, pos string, length string"


def brute(rows):
    """Nodes of the rebuilt conversations, with dictionaries and tuples."""
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        host = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(host, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for path, of in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out[path] = (min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children), len(leaves), saved,
                     hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
    return out


def rows_of(seed, convs, copies=0):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "𝒳y", "hello there", ""])) for t in range(rng.randint(1, 8))]
    rows += [(c, t, "user", "same") for c in range(9000, 9000 + copies) for t in range(7)]
    return rows


def odd():
    rows = rows_of(3, [*range(0, 40), 100, 101, 105, 205, 206, 207, 350, -5, -100, -105])
    rows += [(7, None, None, None), (7, 3, "user", "tie b"), (7, 3, "user", "tie a"), (7, 3, "user", "tie a"), (7, 3, "user", "tie a")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (400, 0, None, "x" * 1_000_000), (400, 1, "", "y" * 1_000_000)]
    rows += [(401, 0, None, "x" * 1_000_000)] + [(500, t, "user", f"turn {t}") for t in range(700)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", "a", "p", "l") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [odd(), rows_of(5, range(0, 120), copies=60)], ids=["odd", "copies"])
def test_nodes_against_brute_force(spark, rows):
    got = sorted(tuple(r) for r in trie.report(trie.build(frame(spark, rows))).collect())
    assert got == sorted(brute(rows).values())


def test_texts_of_nodes(spark):
    rows = rows_of(8, range(30))
    data = frame(spark, rows)
    built = trie.build(data)
    got = {(r.conv_id, r.depth): (r.role, r.text) for r in built.texts(data).join(built.nodes, ["ka", "kb"]).collect()}
    assert got == {v[:2]: path[-1] for path, v in brute(rows).items() if path}


def test_empty_table(spark):
    assert trie.report(trie.build(frame(spark, []))).count() == 0


def test_running_sums_cross_parts(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [(f"k{i % 20:02d}", i, 1) for i in range(200)]
    got = skew.running(spark.createDataFrame(rows, "key string, at long, v long"), "key", [F.col("at")], {"s": F.col("v")}, "running").collect()
    seen, want = defaultdict(int), {}
    for k, i, v in sorted(rows):
        seen[k] += v
        want[k, i] = seen[k]
    assert {(r.key, r["at"]): r.s for r in got} == want and len({r.key for r in got}) == 21


def test_many_to_one_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([(0 if i < 900 else i, i) for i in range(1000)], "k long, v long")
    table = spark.createDataFrame([(0, 900, "hot")] + [(i, 1, "cold") for i in range(900, 990)], "k long, n long, name string")
    got = skew.to_one(rows, table, ["k"], F.col("n"), 1000)
    assert got.count() == 1000 and got.filter("name = 'hot'").count() == 900 and got.filter("name is null").count() == 10
    assert skew.to_one(rows, table, ["k"], F.col("n"), 1000, "inner").count() == 990
