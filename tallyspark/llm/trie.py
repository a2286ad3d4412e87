"""Prefix trie of conversations by whole-sequence collapse: identical conversations become one weighted sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.llm.skew import running, to_one

#: A conversation takes over up to ``HEADS - 1`` turns of the one whose id is the multiple of ``FAMILY`` below its own.
FAMILY = 100
HEADS = 6
#: Ids of an end list that are joined in one row; 2 to the power of this many.
LIST_BITS = 12
_KEY = ["ka", "kb"]
_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass
class Trie:
    """``nodes`` (key, parent key, counts), ``ends`` (one row per conversation with the key of its last node) and
    ``turns`` (conversation, depth and digest of every turn of the distinct sequences)."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame

    def texts(self, conversations: DataFrame) -> DataFrame:
        """Key, ``role`` and ``text`` of the last turn of every node but the root."""
        content = _turns(conversations).groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
        last = self.nodes.filter("depth > 0").select(*_KEY, "conv_id", "depth").join(self.turns, ["conv_id", "depth"])
        return last.join(content, "digest").select(*_KEY, "role", "text")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"))


def _half(of: Column, first: int) -> Column:
    return F.conv(F.substring(of, first, 16), 16, 10).cast("decimal(20,0)")


def _key(depth: Column, x: Column, y: Column) -> list[Column]:
    """A node's 128-bit key from its depth and the sums over its turns."""
    return [F.xxhash64(depth, x.cast("decimal(38,0)")), F.xxhash64(depth, y.cast("decimal(38,0)"))]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (``conv_id``, ``depth``, ``digest``, ``chars``, ``length``) and one row per
    conversation with its ``length``, both written."""
    rows = written(_turns(conversations).select("conv_id", "turn", "digest", F.length("text").cast("long").alias("chars")), "turns")
    rows = running(rows, "conv_id", [F.col("turn"), F.col("digest")], {"pos": F.lit(1).cast("long")}, "ranked")
    host = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("host")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).select(
        "conv_id", "turns", host, (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    hosts = convs.filter("conv_id = host").select("host", F.col("turns").alias("offered"))
    convs = convs.join(hosts, "host", "left").withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))), "convs")
    total = rows.count()
    own = to_one(rows, convs.select("conv_id", "turns", "h", "taken", "length"), ["conv_id"], F.col("turns"), total, "inner")
    own = own.filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars", "length")
    heads = rows.filter(f"conv_id % {FAMILY} = 0 and pos < {HEADS}").select(F.col("conv_id").alias("host"), "pos", "digest", "chars")
    borrowed = convs.filter("taken > 0").join(heads, "host").filter("pos <= taken")
    borrowed = borrowed.select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "length")
    return written(own.unionByName(borrowed), "rebuilt"), convs.select("conv_id", "length")


def build(conversations: DataFrame) -> Trie:
    """The trie of all rebuilt conversations.

    Every turn is hashed together with its depth; the running sum of these 128 bits along a conversation, with the
    depth, is the key of the prefix that ends there, so keys need no order of evaluation and a conversation of any
    length spreads over tasks. Conversations that end at one key are one sequence with a weight and an end list. Only
    one conversation of each sequence goes on. Sequences whose key is no proper prefix are the leaves. Nodes are the
    prefixes of the sequences, their counts sums of weights. A node belongs to the sequence of its smallest member,
    whose nodes are the lower end of its path; what lies below a node is then its own path's rest plus the totals of
    the sequences that pass through it further up than their own nodes.

    Conversations are ordered by turn (null first); repeated turns of one number by the digest of role and text. Rows
    that agree in everything are as many equal turns. Rows without ``conv_id`` belong to no conversation and are left
    out. Null role or text is empty. For an id below zero the family is that of the multiple above it (``c - c % 100``
    with the sign of ``c``). Texts of any length are hashed where they are read and never shuffled. Other columns are
    ignored. An empty table gives no nodes, not even a root.
    """
    turns, convs = rebuilt(conversations)
    mixed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    halves = turns.withColumns({"x1": _half(mixed, 1), "y1": _half(mixed, 17)})
    sums = running(halves, "conv_id", [F.col("depth")], {"x": F.col("x1"), "y": F.col("y1")}, "prefixes")
    key, up = _key(F.col("depth"), F.col("x"), F.col("y")), _key(F.col("depth") - 1, F.col("x") - F.col("x1"), F.col("y") - F.col("y1"))
    prefixes = written(sums.select("conv_id", "depth", "chars", "length", "digest", key[0].alias("ka"), key[1].alias("kb"),
                                   up[0].alias("pa"), up[1].alias("pb")), "keys")
    zero = F.lit(0).cast("long")
    root = [c.alias(n) for c, n in zip(_key(zero, zero, zero), _KEY, strict=True)]

    ends = prefixes.filter("depth = length").select("conv_id", "length", *_KEY)
    ends = written(ends.unionByName(convs.filter("length = 0").select("conv_id", "length", *root)), "ends")
    inner = prefixes.filter("depth < length").select(*_KEY).union(convs.filter("length > 0").select(*root)).distinct()
    sequences = ends.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("length").alias("length"))
    leaves = sequences.join(inner, _KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    sequences = written(sequences.join(leaves, "conv_id", "left").select(
        "conv_id", "weight", "length", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")), "sequences")

    total = prefixes.count()
    paths = to_one(prefixes.drop("length"), sequences, ["conv_id"], F.col("length"), total, "inner").drop("length")
    tops = sequences.select("conv_id", zero.alias("depth"), zero.alias("chars"), F.lit(None).cast("string").alias("digest"), *root,
                            F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "weight", "leaf")
    paths = written(paths.unionByName(tops), "paths")
    nodes = written(paths.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("pa").alias("pa"), F.first("pb").alias("pb"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.first("chars").alias("chars")), "nodes")

    saved = (F.col("n_convs") - 1) * F.col("chars")
    below = running(nodes.select(*_KEY, "conv_id", "depth", saved.alias("saved")), "conv_id", [F.col("depth").desc()], {"rest": F.col("saved")}, "below")
    owners = written(below.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("all")).join(
        sequences.select("conv_id", "length"), "conv_id"), "owners")
    passing = to_one(paths.select("conv_id", "depth", *_KEY), owners, ["conv_id"], F.col("length"), total, "inner")
    passing = passing.filter("depth < top").groupBy(*_KEY).agg(F.sum("all").alias("others"))
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    done = nodes.join(below.select(*_KEY, "rest"), _KEY).join(passing, _KEY, "left").join(children, _KEY, "left")
    done = written(done.select("conv_id", "depth", *_KEY, "pa", "pb", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                               (F.col("rest") + F.coalesce("others", zero)).alias("saved_tokens")), "done")
    parents = done.filter("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("_children"))
    named = to_one(done.filter("depth > 0"), parents, ["pa", "pb"], F.col("_children"), done.count(), "inner").drop("_children")
    named = named.unionByName(done.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return Trie(named, ends.select("conv_id", *_KEY), paths.filter("depth > 0").select("conv_id", "depth", "digest"))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending comma-joined conversation ids per key.

    Ids of one range of ``2 ** LIST_BITS`` numbers are joined first, so a list of any length reaches its task as few rows,
    which are hashed one after the other and never held together.
    """
    blocks = ends.groupBy(*_KEY, F.shiftright("conv_id", LIST_BITS).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY).sortWithinPartitions(*_KEY, "block")

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, state, done = None, None, ([], [], [])

        def close() -> None:
            if last is not None:
                for column, value in zip(done, (*last, state.hexdigest()), strict=True):
                    column.append(value)

        for batch in batches:
            for ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if (ka, kb) == last:
                    state.update(b",")
                else:
                    close()
                    last, state = (ka, kb), hashlib.sha256()
                state.update(ids.encode())
            yield pa.record_batch([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=[*_KEY, "ends_sha256"])
            done = ([], [], [])
        close()
        yield pa.record_batch([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=[*_KEY, "ends_sha256"])

    return dealt.mapInArrow(digest, "ka long, kb long, ends_sha256 string")


def report(trie: Trie) -> DataFrame:
    """The nodes with the digest of their end list in place of the list."""
    return trie.nodes.join(end_digests(trie.ends), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(length(text), 0) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 100 AS host, count(*) AS turns, xor(list_reduce(
             list_concat([4294967295::BIGINT], range(0, 8 * length(conv_id::VARCHAR))), lambda r, k: list_transform(
               [xor(r, CASE WHEN k % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, k // 8 + 1, 1)) ELSE 0 END)],
               lambda y: xor(y >> 1, (y & 1) * 3988292384))[1]), 4294967295::BIGINT) % 6 AS h FROM t GROUP BY conv_id),
     k AS (SELECT c.*, least(c.h, coalesce(o.turns, 0)) AS taken FROM c LEFT JOIN c AS o ON o.conv_id = c.host),
     r AS (SELECT t.conv_id, pos - h + taken AS depth, chars, digest FROM t JOIN k USING (conv_id) WHERE pos > h
           UNION ALL SELECT k.conv_id, pos, chars, digest FROM k JOIN t ON t.conv_id = k.host AND pos <= taken),
     p AS (SELECT conv_id, depth, chars, string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
           UNION ALL SELECT conv_id, 0, 0, '' FROM k),
     n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
                  CASE WHEN depth > 0 THEN substr(path, 1, 64 * (depth - 1)) END AS up FROM p GROUP BY path, depth),
     ch AS (SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
     a AS (SELECT substr(n.path, 1, 64 * d.i) AS path, sum(saved) AS saved_tokens, count(*) FILTER (ch.path IS NULL) AS n_leaves
           FROM n LEFT JOIN ch USING (path), unnest(range(0, n.depth + 1)) AS d(i) GROUP BY 1),
     e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
           FROM (SELECT conv_id, path FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children,
       a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n AS u ON u.path = n.up LEFT JOIN ch ON ch.path = n.path JOIN a ON a.path = n.path LEFT JOIN e ON e.path = n.path
"""
