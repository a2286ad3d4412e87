"""Near copies among vectors by an epsilon grid order join: sorted by grid cells, joined by intervals of the sequence."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.llm.components import components
from tallyspark.llm.skew import running, to_one

MIN_COSINE = 0.93
#: Leading principal dimensions that make the grid and the boxes of intervals.
GRID_DIMS = 8
#: Longer vectors are turned by this many fixed orthonormal directions before their principal dimensions are sought.
WIDEST = 256
#: Numbers in a block of vectors that is shipped at once, and the rows in a leaf of the join inside a pair of blocks.
BLOCK_NUMBERS = 1 << 17
LEAF_ROWS = 128
FANOUT = 8
#: Bounds on distances leave this much room for rounding; a cosine this close to the limit is summed exactly.
SLACK, BORDER = 1e-9, 1e-12
_AT = ["label", "dim"]
_SUMMARY = "n long, weight long, first long, center array<double>, radius double, low array<double>, high array<double>"


def _rows(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow list column the rows of ``size`` numbers, and these as a matrix; null elements become nan."""
    import pyarrow.compute as pc

    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(at)).to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), size)


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``key`` (digest of the numbers), ``dim`` and ``unit`` (the vector of length one, 64-bit
    floats) of every row; ``key`` is null where the row can link with nothing."""
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column, n = batch.column("embedding"), batch.num_rows
            keys, units, dims = [None] * n, [None] * n, [None] * n
            for size in {k for k in pc.unique(pc.list_value_length(column)).to_pylist() if k}:
                at, rows = _rows(column, size)
                largest = np.abs(rows).max(axis=1)
                fine = np.isfinite(largest) & (largest > 0)
                at, rows, largest = at[fine], rows[fine] + 0.0, largest[fine, None]
                unit = rows / largest
                unit /= np.sqrt(np.square(unit).sum(axis=1))[:, None]
                for k, row, u in zip(at.tolist(), rows, unit, strict=True):
                    keys[k], units[k], dims[k] = hashlib.sha256(row.tobytes()).digest(), u.tobytes(), size
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()),
                                   pa.array(units, pa.binary())], names=["vec_id", "label", "key", "dim", "unit"])

    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return typed.mapInArrow(run, f"vec_id long, label {kind}, key binary, dim int, unit binary")


@lru_cache(maxsize=4)
def _turned(dim: int) -> np.ndarray | None:
    """Fixed orthonormal directions for vectors too long for a full covariance matrix."""
    if dim <= WIDEST:
        return None
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, WIDEST)))[0]


def principal(classes: DataFrame, dims: int = GRID_DIMS) -> tuple[int, np.ndarray]:
    """The commonest vector length and orthonormal leading directions for it, from the moments of all its rows.

    A task sends one row of sums; the driver gets the sums of all, at most ``WIDEST`` squared numbers.
    """
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").head()
    if common is None:
        return 0, np.zeros((0, 0))
    dim = int(common["dim"])
    turned = _turned(dim)
    width = min(dim, WIDEST)

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 + width + width * width)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("unit").to_pylist()), dtype=np.float64).reshape(-1, dim)
            rows = rows if turned is None else rows @ turned
            total += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = classes.filter(F.col("dim") == dim).select("unit").mapInArrow(moments, "sums array<double>")
    got = sums.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    values = np.array([r.v for r in got])
    n, mean = values[0], values[1:1 + width] / values[0]
    cov = values[1 + width:].reshape(width, width) / n - np.outer(mean, mean)
    basis = np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1][:, :dims]
    return dim, basis if turned is None else turned @ basis


def projected(rows: np.ndarray, common: int, basis: np.ndarray) -> np.ndarray:
    """Coordinates along the principal directions; vectors of another length than the commonest use their first numbers."""
    return rows @ basis if rows.shape[1] == common else rows[:, :GRID_DIMS]


def ordered(classes: DataFrame, common: int, basis: np.ndarray, eps: float) -> DataFrame:
    """The classes with their place ``pos`` (from 1) in epsilon grid order within label and length, and their block."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            units, sizes = batch.column("unit").to_pylist(), np.array(batch.column("dim").to_pylist())
            cells = [None] * batch.num_rows
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = np.frombuffer(b"".join(units[k] for k in at), dtype=np.float64).reshape(-1, size)
                for k, cell in zip(at.tolist(), np.floor(projected(rows, common, basis) / eps).astype(int).tolist(), strict=True):
                    cells[k] = cell
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    placed = classes.mapInArrow(run, f"label {kind}, key binary, dim int, id long, n long, unit binary, cells array<long>")
    placed = written(placed.withColumn("stratum", F.struct(*_AT)), "cells")
    placed = running(placed, "stratum", [F.col("cells"), F.col("key")], {"pos": F.lit(1).cast("long")}, "sequence")
    size = F.greatest(F.lit(LEAF_ROWS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))).cast("long")
    return placed.withColumn("block", F.floor((F.col("pos") - 1) / size)).drop("stratum", "cells")


def packed(sequence: DataFrame, common: int, basis: np.ndarray) -> DataFrame:
    """One row per block: its vectors in one value, ids and weights beside them, center, radius and grid box."""
    kind = sequence.schema["label"].dataType.simpleString()

    def pack(key, rows):
        import pandas as pd

        rows = rows.sort_values("pos")
        units = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), -1)
        center = units.mean(axis=0)
        boxes = projected(units, common, basis)
        return pd.DataFrame([{
            "label": key[0], "dim": key[1], "block": key[2], "n": len(rows), "weight": int(rows["n"].sum()), "first": int(rows["id"].iloc[0]),
            "center": center, "radius": float(np.sqrt(np.square(units - center).sum(axis=1).max())), "low": boxes.min(axis=0), "high": boxes.max(axis=0),
            "units": units.tobytes(), "pos": rows["pos"].to_numpy(np.int64).tobytes(), "ids": rows["id"].to_numpy(np.int64).tobytes(),
            "weights": rows["n"].to_numpy(np.int64).tobytes()}])

    return sequence.groupBy(*_AT, "block").applyInPandas(
        pack, f"label {kind}, dim int, block long, {_SUMMARY}, units binary, pos binary, ids binary, weights binary")


def _merged(intervals: DataFrame) -> DataFrame:
    """Intervals of ``FANOUT`` neighbouring ones each."""
    kind = intervals.schema["label"].dataType.simpleString()

    def merge(key, rows):
        import pandas as pd

        rows = rows.sort_values("block")
        centers = np.stack(rows["center"].to_list())
        center = np.average(centers, axis=0, weights=rows["n"])
        reach = np.sqrt(np.square(centers - center).sum(axis=1)) + rows["radius"].to_numpy()
        return pd.DataFrame([{
            "label": key[0], "dim": key[1], "block": key[2], "n": int(rows["n"].sum()), "weight": int(rows["weight"].sum()),
            "first": int(rows["first"].iloc[0]), "center": center, "radius": float(reach.max()),
            "low": np.stack(rows["low"].to_list()).min(axis=0), "high": np.stack(rows["high"].to_list()).max(axis=0)}])

    up = intervals.withColumn("up", F.floor(F.col("block") / FANOUT))
    return up.groupBy(*_AT, "up").applyInPandas(merge, f"label {kind}, dim int, block long, {_SUMMARY}")


def _length(squares: Column) -> Column:
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))


def _verdict(eps: float) -> Column:
    """far, near (every vector of one interval is linked with every one of the other) or open, for intervals x and y."""
    apart = _length(F.zip_with("x.center", "y.center", lambda a, b: (a - b) * (a - b)))
    reach = F.col("x.radius") + F.col("y.radius")
    above = F.zip_with("x.low", "y.high", lambda a, b: a - b)
    below = F.zip_with("y.low", "x.high", lambda a, b: a - b)
    gap = _length(F.zip_with(above, below, lambda a, b: F.pow(F.greatest(a, b, F.lit(0.0)), 2)))
    return (F.when((apart - reach > eps + SLACK) | (gap > eps + SLACK), "far")
            .when(apart + reach < eps - SLACK, "near").otherwise("open"))


def joined_intervals(blocks: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks that must be compared, and pairs of intervals (``level``, summaries ``x`` and ``y``) that link as a whole.

    The sequence of a label is cut into blocks, blocks into intervals of ``FANOUT``, and so on. From the whole sequence
    with itself, each round judges all pairs of one level at once and splits the open ones.
    """
    levels = [written(blocks.select(*_AT, "block", *[c.split()[0] for c in _SUMMARY.split(", ")]), "intervals")]
    while levels[-1].filter("block > 0").head() is not None:
        levels.append(written(_merged(levels[-1]), "intervals"))
    pairs = levels[-1].select(*_AT, F.col("block").alias("i"), F.col("block").alias("j"))
    near = []
    for level in range(len(levels) - 1, -1, -1):
        node = levels[level]
        side = lambda name, at: node.select(*_AT, F.col("block").alias(at), F.struct("block", "n", "weight", "first", "center", "radius", "low", "high").alias(name))  # noqa: B023, E731
        judged = pairs.join(side("x", "i"), [*_AT, "i"]).join(side("y", "j"), [*_AT, "j"]).withColumn("verdict", _verdict(eps))
        slim = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("block", "weight", "first")]).alias(s)
        judged = written(judged.filter("verdict <> 'far'").select(*_AT, "i", "j", slim("x"), slim("y"), "verdict"), "judged")
        near.append(judged.filter("verdict = 'near'").select(*_AT, F.lit(level).alias("level"), "x", "y"))
        pairs = judged.filter("verdict = 'open'").select(*_AT, "i", "j")
        if level:
            below = lambda at: F.explode(F.sequence(F.col(at) * FANOUT, F.col(at) * FANOUT + FANOUT - 1))
            pairs = pairs.withColumn("i", below("i")).withColumn("j", below("j")).filter("i <= j")
    whole = near[0]
    for more in near[1:]:
        whole = whole.union(more)
    return pairs, whole


class _Tree:
    """Halves of a block's sequence down to ``LEAF_ROWS``, each with center, radius and grid box."""

    def __init__(self, rows: np.ndarray, boxes: np.ndarray, start: int = 0) -> None:
        self.start, self.end = start, start + len(rows)
        self.center = rows.mean(axis=0)
        self.radius = math.sqrt(np.square(rows - self.center).sum(axis=1).max())
        self.low, self.high = boxes.min(axis=0), boxes.max(axis=0)
        half = len(rows) // 2
        self.parts = [] if len(rows) <= LEAF_ROWS else [_Tree(rows[:half], boxes[:half], start), _Tree(rows[half:], boxes[half:], start + half)]

    def relation(self, other: _Tree, eps: float) -> str:
        apart = math.sqrt(np.square(self.center - other.center).sum())
        gap = np.maximum(np.maximum(self.low - other.high, other.low - self.high), 0)
        if apart - self.radius - other.radius > eps + SLACK or math.sqrt(np.square(gap).sum()) > eps + SLACK:
            return "far"
        return "near" if apart + self.radius + other.radius < eps - SLACK else "open"


def linked(a: np.ndarray, b: np.ndarray | None, grid, cosine: float, eps: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (``a`` itself if None) link, by recursion over halves of both sequences."""
    left = _Tree(a, grid(a))
    right = left if b is None else _Tree(b, grid(b))
    b, same = (a, True) if b is None else (b, False)
    out = np.zeros((len(a), len(b)), dtype=bool)

    def visit(x: _Tree, y: _Tree) -> None:
        relation = x.relation(y, eps)
        if relation == "far":
            return
        if relation == "near":
            out[x.start:x.end, y.start:y.end] = True
        elif not x.parts and not y.parts:
            got = a[x.start:x.end] @ b[y.start:y.end].T
            hit = got >= cosine
            for i, j in np.argwhere(np.abs(got - cosine) < BORDER):
                hit[i, j] = math.fsum(a[x.start + i] * b[y.start + j]) >= cosine
            out[x.start:x.end, y.start:y.end] = hit
        elif same and x is y:
            visit(x.parts[0], x.parts[0])
            visit(x.parts[0], x.parts[1])
            visit(x.parts[1], x.parts[1])
        elif x.parts and (not y.parts or x.end - x.start >= y.end - y.start):
            for part in x.parts:
                visit(part, y)
        else:
            for part in y.parts:
                visit(x, part)

    visit(left, right)
    if same:
        out |= out.T
        np.fill_diagonal(out, False)
    return out


def _tied(hit: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id in the connected part of every row and column of ``hit``."""
    roots_a, roots_b = a.copy(), b.copy()
    open_a, open_b = hit.any(axis=1), hit.any(axis=0)
    for start in np.flatnonzero(open_a):
        if not open_a[start]:
            continue
        rows, columns, fresh = np.zeros(len(a), bool), np.zeros(len(b), bool), np.zeros(len(a), bool)
        fresh[start] = True
        while fresh.any():
            rows |= fresh
            open_a &= ~fresh
            reached = hit[fresh].any(axis=0) & open_b
            open_b &= ~reached
            columns |= reached
            fresh = hit[:, reached].any(axis=1) & open_a
            if same:
                fresh |= reached & open_a
        low = min(a[rows].min(), b[columns].min() if columns.any() else a[start])
        roots_a[rows] = low
        roots_b[columns] = low
    return roots_a, roots_b


def compared(pairs: DataFrame, blocks: DataFrame, common: int, basis: np.ndarray, cosine: float, eps: float) -> DataFrame:
    """Per pair of blocks and vector that links there: ``links`` (rows it links with), its ``id`` and the smallest id it is tied to."""
    kind = blocks.schema["label"].dataType.simpleString()

    def compare(key, rows):
        import pandas as pd

        rows = rows.sort_values("block")
        unpack = lambda k, c, t: np.frombuffer(rows[c].iloc[k], dtype=t)
        size, same = int(key[1]), len(rows) == 1
        a, b = (unpack(k, "units", np.float64).reshape(-1, size) for k in (0, -1))
        hit = linked(a, None if same else b, lambda u: projected(u, common, basis), cosine, eps)
        ids, pos = [unpack(k, "ids", np.int64) for k in (0, -1)], [unpack(k, "pos", np.int64) for k in (0, -1)]
        roots = _tied(hit, *ids, same)
        counts = [hit @ unpack(-1, "weights", np.int64).astype(np.float64), unpack(0, "weights", np.int64).astype(np.float64) @ hit]
        out = [pd.DataFrame({"pos": pos[k], "links": counts[k].astype(np.int64), "id": ids[k], "root": roots[k]}) for k in range(1 if same else 2)]
        found = pd.concat(out)
        found = found[found["links"] > 0]
        found.insert(0, "label", key[0])
        found.insert(1, "dim", key[1])
        return found

    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    shipped = sides.join(blocks.select(*_AT, "block", "units", "pos", "ids", "weights"), [*_AT, "block"])
    return shipped.groupBy(*_AT, "i", "j").applyInPandas(compare, f"label {kind}, dim int, pos long, links long, id long, root long")


def near_vectors(vectors: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Rows link if their labels are equal and not null, their vectors have the same length and a cosine of at least
    ``cosine``. Equal vectors of one label are one class with a weight from the start. Unit vectors are sorted by label
    and by grid cells of the side that the cosine stands for, along the leading principal directions of all vectors.
    Blocks of the sequence are joined recursively: a pair of intervals whose centers or grid boxes are too far apart for
    any link is skipped, one whose farthest vectors still link is counted as a whole, others are split; what is still
    open at the level of blocks is compared in one task per pair of blocks, there again by halves. Links are counted per
    vector and never listed; a pair of blocks passes on one tie per vector, and components grow from the ties.

    A vector that is null, empty or zero or holds null or non-finite numbers, and a row with a null label or id, links
    with nothing: no links, itself as component, kept. Rows that share an id are one vertex of the components, each with
    its own links. Links at the limit are decided by an exactly rounded sum over the unit vectors. Very long vectors make
    smaller blocks; beyond ``WIDEST`` numbers a fixed turn replaces the full covariance. Other columns are ignored. An
    empty table gives an empty result.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = written(prepared(vectors), "vectors")
    able = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = written(rows.filter(able).groupBy("label", "key", "dim").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")), "classes")
    common, basis = principal(classes)
    sequence = written(ordered(classes, common, basis, eps), "ordered")
    blocks = written(packed(sequence, common, basis), "blocks")
    pairs, whole = joined_intervals(blocks, eps)
    found = written(compared(pairs, blocks, common, basis, cosine, eps), "found")

    whole = written(whole, "whole")
    alike = F.col("x.block") == F.col("y.block")
    sides = whole.select(*_AT, "level", "x.block", F.col("x.first").alias("first"), F.col("y.weight").alias("links"), alike.alias("alike")).union(
        whole.filter(~alike).select(*_AT, "level", "y.block", F.col("y.first").alias("first"), F.col("x.weight").alias("links"), F.lit(False)))
    sides = sides.groupBy(*_AT, "level", "block", "first").agg(F.sum("links").alias("links"), F.max("alike").alias("alike"))
    width = F.pow(F.lit(FANOUT), F.col("level")).cast("long")
    spread = sides.withColumn("block", F.explode(F.sequence(F.col("block") * width, (F.col("block") + 1) * width - 1)))
    spread = written(spread.join(blocks.select(*_AT, "block", F.col("first").alias("start")), [*_AT, "block"]), "spread")
    added = spread.groupBy(*_AT, "block").agg(F.sum("links").alias("more"), F.sum(F.col("alike").cast("long")).alias("alike"), F.first("start").alias("start"))
    added = written(added, "added")

    direct = found.groupBy(*_AT, "pos").agg(F.sum("links").alias("links"))
    counted = sequence.drop("unit").join(direct, [*_AT, "pos"], "left").join(added, [*_AT, "block"], "left")
    zero = F.lit(0).cast("long")
    others = F.coalesce("links", zero) + F.coalesce("more", zero) - F.coalesce("alike", zero) * F.col("n")
    counted = written(counted.select("label", "key", "id", "n", "start", (F.col("n") - 1 + others).cast("long").alias("n_links")), "counted")

    ties = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    ties = ties.union(counted.filter("start is not null").select("id", "start")).union(spread.select("start", "first"))
    ties = ties.union(whole.select("x.first", "y.first"))
    tied = written(components(written(ties, "ties")), "components")
    counted = counted.join(tied, "id", "left").select("label", "key", "n", "n_links", F.coalesce("component", "id").alias("component_id"))
    counted = written(counted, "classes")

    joined = to_one(rows.filter(able).select("vec_id", "label", "key"), counted, ["label", "key"], F.col("n"), rows.count(), "inner")
    alone = rows.filter(~able).select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
             ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
     r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
     c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
     n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
