"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_broadcast, written
from tallyspark.llm.components import components
from tallyspark.llm.textstats import chunks, mixed, rolling

WORDS = 5
PERCENT = 75
#: Second-level partitions of each first-level one and how many of them may differ, for sets with many differences;
#: sets with up to ``FEW`` differences take one first-level partition and all pairs of second-level ones.
SECOND, DIFFER = 2, 1
FEW = 5
#: Partitions beyond the differences, as a share of them, under one seed after the other. The first row counts common
#: shingles as weak, the second only empty partitions.
SLACKS = (0.2, 0.5, 1.0, 2.0, 3.0)
LATE_SLACKS = (0.2, 0.5, 1.0)
#: A shingle in at least so many sets is common; at most so many are told to the tasks. Both decide the cost only.
COMMON = 64
MAX_COMMON = 200_000
#: Ids that may be broadcast when the sets of candidate documents are made.
BROADCAST_IDS = 1_000_000
#: 64-bit words of the bitmap that stands for a set in a first look at a pair.
BITMAP = 16
#: Shingles whose signatures make one bucket, and the bits of a signature kept beside the number of its bucket. A chance
#: agreement of two signatures costs one comparison.
BUCKET_SHINGLES = 1_500_000
KEY_BITS = 40


#: Bytes hashed at a time, and the value of each byte (A-Z as a-z) at each of the first places of a word.
BLOCK = 1 << 17
_PLACES = 64
_PLACED = mixed(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1))
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after the other, and the number of words of each text.

    A word's hash is the sum of a mixed value per byte and its place in the word (A-Z count as a-z), so it is computed
    for all words of a block at once. Blocks end at white space, a longer word makes a longer block.
    """
    joined = b" ".join(texts) + b" "
    found, starts, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    data = np.frombuffer(joined, dtype=np.uint8)
    while low < len(data):
        high = min(low + BLOCK, len(data))
        while not _IS_SPACE[data[high - 1]]:
            more = data[high:high + BLOCK]
            gap = np.flatnonzero(_IS_SPACE[more])
            high += int(gap[0]) + 1 if len(gap) else len(more)
        block = data[low:high]
        space = _IS_SPACE[block]
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if len(first):
            at = np.arange(len(block), dtype=np.int32)
            begin = np.zeros(len(block), np.int32)
            begin[first] = first
            place = at - np.maximum.accumulate(begin)
            value = _PLACED[np.minimum(place, _PLACES - 1) * 256 + _LOWER[block]]
            value[space] = 0
            far = np.flatnonzero((place >= _PLACES) & ~space)
            value[far] = mixed(place[far].astype(np.uint64) * np.uint64(256) + _LOWER[block[far]] + np.uint64(1))
            found.append(np.add.reduceat(value, first))
            starts.append(first + low)
        low = high
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts), begins))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text; A-Z count as a-z."""
    flat, counts = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    runs = rolling(flat, words)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            run = np.sort(runs[at:at + n - words + 1])
            out.append(run[np.concatenate(([True], run[1:] != run[:-1]))])
        else:
            out.append(rolling(flat[at:at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


@cache
def bands(percent: int, top: int) -> list[int]:
    """Largest size of each band; sizes of a band reach up to ``100 / percent`` times its smallest."""
    ends, low = [], 1
    while not ends or ends[-1] < top:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return ends


@cache
def layout(end: int, percent: int, seed: int) -> tuple[int, int, int]:
    """(differences, partitions, partitions per signature) of the band that ends at ``end``, under a seed.

    Sets linked at ``percent`` differ in at most ``(100 - percent) / (100 + percent)`` of their summed sizes.
    """
    differ = (100 - percent) * 2 * end // (100 + percent)
    if differ <= FEW:
        return differ, differ + 3 + min(seed, 3), 2
    slack = (*SLACKS, *LATE_SLACKS, 0)[seed]
    first = differ // (DIFFER + 1) + 1 + math.ceil(slack * differ / SECOND)
    return differ, first * SECOND, SECOND - DIFFER


def members(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` stand in the sorted ``common``."""
    if not len(common):
        return np.zeros(len(hashes), bool)
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes


def signatures(hashes: np.ndarray, known: np.ndarray, band: int, end: int, percent: int) -> Iterator[np.ndarray]:
    """Signatures of one set in one band instance, seed by seed; ``known`` marks its common shingles."""
    return (found for found, *_ in band_signatures([hashes], [known], band, end, percent))


def band_signatures(sets: list[np.ndarray], known: list[np.ndarray], band: int, end: int,
                    percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Signatures of several sets in one band instance, seed by seed, each with the number of its set and how many of that
    set's signatures under this seed it shares with any linked set (0: maybe none).

    A seed deals the shingle domain into N partitions. Two linked sets differ in at most d shingles, so at least N - d
    partitions hold the same in both, and so does a subset of them. A signature is the content of such a subset
    (``SECOND - DIFFER`` of the second-level partitions; two of all for few differences).

    A partition whose shingles are all common, or that is empty, is weak; a signature of weak partitions alone would
    join strangers. As long as a set has fewer than N - d weak partitions, one of the partitions that agree is strong,
    and its strong signatures suffice. A set with more emits them under the next seed as well, and so on; of two sets
    the one that is done first is safe under a seed that both use. Later seeds deal into more partitions, of which
    fewer need to be strong. Sets made of common shingles come to the second row of seeds, in which only empty
    partitions are weak, and at last to one in which none is: they emit all. So every linked pair shares a signature.

    A partition that agrees is weak in both sets or in none. So of w weak partitions at most w agree, and a linked pair
    shares at least N - d - w signatures of single partitions.
    """
    last_seed = len(SLACKS) + len(LATE_SLACKS)
    live = np.arange(len(sets))
    owner = np.repeat(live, [len(s) for s in sets])
    hashes, rare = np.concatenate(sets), ~np.concatenate(known)
    for seed in range(last_seed + 1):
        differ, parts, take = layout(end, percent, seed)
        cells = len(live) * parts
        x = mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (seed * 4096 + band + 1) % (1 << 64)))
        cell = (x >> np.uint64(40)).astype(np.int64) % parts + owner * parts
        y = mixed(x)
        low = np.bincount(cell, weights=(y & np.uint64(0xFFFFFFFF)).astype(float), minlength=cells).astype(np.uint64)
        high = np.bincount(cell, weights=(y >> np.uint64(32)).astype(float), minlength=cells).astype(np.uint64)
        place = np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        content = mixed((low + (high << np.uint64(32))).reshape(-1, parts) + place)
        strong = np.bincount(cell[rare] if seed < len(SLACKS) else cell, minlength=cells).reshape(-1, parts) > 0
        if seed == last_seed:
            strong[:] = True
        agree, weak = parts - differ, parts - strong.sum(axis=1)
        salt = np.uint64((band * 64 + seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        shared = np.maximum(0, agree - weak)
        if take == 1:
            chosen, found = strong, content
        else:
            a, b = np.array(list(combinations(range(parts), take))).T
            chosen, found = strong[:, a] | strong[:, b], mixed(content[:, a] * np.uint64(3) + content[:, b])
            shared = np.minimum(1, shared)
        inside = np.nonzero(chosen)[0]
        yield mixed(found[chosen] ^ salt), live[inside], shared[inside]
        again = weak >= agree
        if not again.any():
            break
        kept = again[owner]
        hashes, rare, owner, live = hashes[kept], rare[kept], (np.cumsum(again) - 1)[owner[kept]], live[again]


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """Per document the size and a 128-bit digest of its set; besides, shingles that are frequent in a batch (``hits``)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, rows, every = batch.column(0), [], []
            for part in chunks(batch.column(1).to_pylist()):
                for s in shingle_sets(part, words):
                    d = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                    rows.append((len(s), (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
                    every.append(s)
            found, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = np.flatnonzero(n >= 3)
            often = often[np.argsort(-n[often], kind="stable")[:20_000]]
            m, nothing = len(often), [None]
            table = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids, pa.nulls(m, ids.type)]), *[pa.array([*c, *nothing * m], pa.int64()) for c in table],
                 pa.array([*nothing * len(rows), *found[often].view(np.int64).tolist()], pa.int64()),
                 pa.array([*nothing * len(rows), *n[often].tolist()], pa.int64())],
                ["doc_id", "n_shingles", "d1", "d2", "shingle", "hits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, shingle long, hits long")


def _common_shingles(summaries: DataFrame) -> np.ndarray:
    """At most ``MAX_COMMON`` shingles of at least ``COMMON`` sets, sorted; a bounded list for the tasks."""
    often = summaries.filter("hits is not null").groupBy("shingle").agg(F.sum("hits").alias("n")).filter(F.col("n") >= COMMON)
    rows = often.orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in rows], dtype=np.int64).view(np.uint64))


def packed(keys: np.ndarray, at: np.ndarray) -> bytes:
    """Sorted keys below 2 ** ``KEY_BITS`` as steps, and numbers below 2 ** 24 beside them, byte place by byte place."""
    import pyarrow as pa

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
    places = at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return pa.compress(np.concatenate([steps.T.ravel(), places.T.ravel()]).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` made of ``n`` keys and numbers."""
    import pyarrow as pa

    width = KEY_BITS // 8 + 3
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    steps, places = np.zeros((n, 8), np.uint8), np.zeros((n, 4), np.uint8)
    steps[:, :KEY_BITS // 8], places[:, :3] = raw[:KEY_BITS // 8].T, raw[KEY_BITS // 8:].T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), places.view("<u4").ravel().astype(np.int64)


def _signed(docs: DataFrame, reps: DataFrame, words: int, percent: int, common: np.ndarray, buckets: int) -> DataFrame:
    """Signatures of the representatives, each in its own band and as the smaller set of the next, dealt into buckets.

    A row holds the signatures of one bucket that some documents emit: ``n`` signatures as ``packed``, with numbers that
    point into the lists ``id``, ``size``, ``part`` (band and seed) and ``shared`` (see ``band_signatures``).
    """
    lists = {"id": "long", "size": "int", "part": "short", "shared": "int"}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int16(), pa.int32())]
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for part in chunks(batch.column(1).to_pylist()):
                sets = shingle_sets(part, words)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                doc = np.array(ids[at:at + len(part)], dtype=np.int64)
                at += len(part)
                known = np.split(members(np.concatenate(sets), common), np.cumsum(sizes)[:-1])
                ends = bands(percent, 1 << int(sizes.max()).bit_length() + 2)
                banded = defaultdict(list)
                for i in np.flatnonzero(sizes).tolist():
                    own = bisect_left(ends, len(sets[i]))
                    banded[own].append((i, 0))
                    banded[own + 1].append((i, 1))
                sigs, whose, known_of, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], 0
                for band, inside in banded.items():
                    of = np.array(inside)
                    found_in = band_signatures([sets[i] for i, _ in inside], [known[i] for i, _ in inside], band, ends[band], percent)
                    for seed, (found, number, shared) in enumerate(found_in):
                        set_of, first, place = np.unique(number, return_index=True, return_inverse=True)
                        sigs.append(found)
                        whose.append(last + place)
                        known_of.append(np.column_stack([of[set_of, 0], of[set_of, 1] * 16 + seed, shared[first]]))
                        last += len(set_of)
                sigs, whose, known_of = np.concatenate(sigs), np.concatenate(whose), np.concatenate(known_of)
                bucket, keys = (sigs % np.uint64(buckets)).astype(np.int64), sigs >> np.uint64(64 - KEY_BITS)
                order = np.lexsort((keys, bucket))
                bucket, keys, whose = bucket[order], keys[order], whose[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                    used, number = np.unique(whose[low:high], return_inverse=True)
                    i, tag, shared = known_of[used].T
                    rows.append((int(bucket[low]), high - low, packed(keys[low:high], number), doc[i], sizes[i], tag, shared))
                if rows:
                    number, n, data, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary()),
                         *[pa.array([x.astype(t.value_type.to_pandas_dtype()) for x in c], t) for c, t in zip(rest, kinds)]],
                        ["bucket", "n", "data", *lists])

    return _chosen(docs, reps).mapInArrow(run, "bucket int, n int, data binary, " + ", ".join(f"{c} array<{t}>" for c, t in lists.items()))


def _met(signed: DataFrame, buckets: int) -> DataFrame:
    """``sig``, ``id``, ``size``, ``part``, ``shared`` and ``n`` (rows) of the signatures that several documents emit."""
    def meet(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        bucket, counts = table.column("bucket")[0].as_py(), table.column("n").to_pylist()
        found = [unpacked(data.as_py(), n) for data, n in zip(table.column("data"), counts)]
        lists = {c: table.column(c).combine_chunks() for c in ("id", "size", "part", "shared")}
        starts = np.cumsum([0, *[len(x) for x in lists["id"]]])
        keys = np.concatenate([k for k, _ in found])
        whose = np.concatenate([place + start for (_, place), start in zip(found, starts.tolist())])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(first, len(keys)))
        at = np.flatnonzero(np.repeat(n > 1, n))
        whose = whose[order[at]]
        column = lambda c: pa.array(lists[c].flatten().to_numpy()[whose])
        return pa.table({
            "sig": pa.array(keys[at].astype(np.int64) * buckets + bucket), "id": column("id"), "size": column("size"), "part": column("part"),
            "shared": column("shared"), "n": pa.array(np.repeat(n, n)[at].astype(np.int32))})

    return signed.groupBy("bucket").applyInArrow(meet, "sig long, id long, size int, part short, shared int, n int")


def _groups(met: DataFrame) -> DataFrame:
    """``sig``, ``id``, ``size``, ``first`` and ``n`` (members) of the signatures that join documents; ``first`` has the smallest set.

    A set that shares at least k signatures with every linked one leaves out its k - 1 commonest. A linked pair still meets
    in the rarest signature that it shares: as many more are commoner, and neither set leaves that one out. So strangers
    with a passage in common mostly do not meet. The order is the same for all sets: by ``n``, then ``sig``.
    """
    commonest = Window.partitionBy("id", "part").orderBy(F.desc("n"), "sig")
    kept = met.withColumn("place", F.row_number().over(commonest)).filter("place >= shared").select("sig", "id", "size")
    by_size = Window.partitionBy("sig").orderBy("size", "id")
    kept = kept.select("sig", "id", "size", F.first("id").over(by_size).alias("first"), F.lead("id").over(by_size).alias("next"))
    kept = kept.filter("id <> first or next <> id").drop("next")
    return written(kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig"))), "grouped")


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` of the documents named by a written table of ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").join(
        bounded_broadcast(ids.select(F.col("id").alias("doc_id")), BROADCAST_IDS), "doc_id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """``id``, ``common`` and ``rare`` shingles, a ``sketch`` (their leading 16 bits) and a bitmap (``bits``) of the documents
    named by ``ids``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def bits(s: np.ndarray) -> np.ndarray:
            on = np.zeros(BITMAP * 64, np.uint8)
            on[(s % np.uint64(BITMAP * 64)).astype(np.int64)] = 1
            return np.packbits(on).view(np.int64)

        long, short = pa.list_(pa.int64()), pa.list_(pa.int16())
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in chunks(batch.column(1).to_pylist()):
                sets = shingle_sets(part, words)
                known = [members(s, common) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array([s[k].view(np.int64) for s, k in zip(sets, known)], long),
                     pa.array([s[~k].view(np.int64) for s, k in zip(sets, known)], long),
                     pa.array([np.unique(s >> np.uint64(48)).astype(np.uint16).view(np.int16) for s in sets], short),
                     pa.array([bits(s) for s in sets], long)],
                    ["id", "common", "rare", "sketch", "bits"])
                at += len(part)

    return _chosen(docs, ids).mapInArrow(run, "id long, common array<long>, rare array<long>, sketch array<short>, bits array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose bitmaps allow the similarity: each bit that only one set has is a shingle that the
    other lacks. So few bytes of a set travel with a pair that cannot be linked."""
    size = F.size("common") + F.size("rare")
    left = sets.select(F.col("id").alias("a"), size.alias("m"), F.col("bits").alias("x"))
    right = sets.select(F.col("id").alias("b"), size.alias("n"), F.col("bits").alias("y"))
    lacks = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITMAP)), F.lit(0))
    both = F.least(F.col("m") - lacks("x", "y"), F.col("n") - lacks("y", "x"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.col("m") + F.col("n") - both)).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) with their sizes (``m``, ``n``), a bound on the shared shingles (``both``) and ``linked``.

    Sketches are compared first: shared shingles are at most the shared sketch values and what collisions inside the
    smaller loss hide. Only pairs that may reach the similarity are compared on whole sets.
    """
    size = F.size("common") + F.size("rare")
    left = sets.select(F.col("id").alias("a"), size.alias("m"), F.col("sketch").alias("x"))
    right = sets.select(F.col("id").alias("b"), size.alias("n"), F.col("sketch").alias("y"))
    hidden = F.least(F.col("m") - F.size("x"), F.col("n") - F.size("y"))
    both = F.least(F.size(F.array_intersect("x", "y")) + hidden, "m", "n")
    bounded = written(pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", both.alias("both")), "sketched")
    enough = 100 * F.col("both") >= percent * (F.col("m") + F.col("n") - F.col("both"))
    x = sets.select(F.col("id").alias("a"), F.concat("common", "rare").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.concat("common", "rare").alias("y"))
    exact = bounded.filter(enough).select("a", "b").join(x, "a").join(y, "b").select(
        "a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    links = exact.filter(enough).select("a", "b", F.lit(True).alias("linked")).distinct()
    return bounded.join(links, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def _ends(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _centres(grouped: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the groups that do not hang together: ``sig``, ``id``, ``smallest`` (size in the group) and ``centre``, of the
    component with most members the set with the fewest rare shingles."""
    rare = bounded_broadcast(written(sets.groupBy("id").agg(F.min(F.size("rare")).alias("rare")), "rare-counts"), BROADCAST_IDS)
    member = grouped.filter("n > 2").join(bounded_broadcast(labels, BROADCAST_IDS), "id", "left").join(rare, "id").select("sig", "id", "size", "rare", F.coalesce("component", "id").alias("component"))
    parts = member.groupBy("sig", "component").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min(F.struct("rare", "id")).alias("lead"))
    whole = parts.groupBy("sig").agg(
        F.count(F.lit(1)).alias("parts"), F.min("size").alias("smallest"),
        F.max(F.struct("n", -F.col("lead.rare"), -F.col("lead.id"))).alias("most"))
    whole = whole.filter("parts > 1").select("sig", "smallest", (-F.col("most.col3")).alias("centre"))
    return member.select("sig", "id").join(whole, "sig")


def _outsiders(centred: DataFrame, labels: DataFrame, checked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of one group and different components that may still be linked.

    Of two such members at least one, z, does not hang together with the group's centre; all these are looked at. Let c
    be any set, b a set linked to z and at least ``smallest`` large. What b and z share inside c cannot make up for what
    z differs from c, so b and z share outside c at least half of |z delta c| - |c| + (smallest * (100 + percent)
    - (|z| + smallest) * (100 - percent)) / (100 + percent), where that is positive. So z finds b by its shingles outside
    c, and may leave out as many less one: those that most of the sets hold. Once b is known, its own size stands for
    ``smallest``, and z may leave out more. As c serves whatever z has been compared
    with, or the empty set, for which this is the usual prefix; z takes the one that shares most with it.
    """
    labels = bounded_broadcast(labels, BROADCAST_IDS)
    component = lambda name: labels.select(F.col("id").alias(name), F.col("component").alias(f"{name}_component"))
    known = centred.join(component("id"), "id", "left").join(component("centre"), "centre", "left")
    apart = known.filter(F.coalesce("id_component", "id") != F.coalesce("centre_component", "centre"))
    apart = apart.groupBy(F.col("id").alias("z")).agg(F.min("smallest").alias("smallest"))
    sizes = sets.select(F.col("id").alias("z"), (F.size("common") + F.size("rare")).alias("m"))
    apart = written(apart.join(sizes, "z"), "apart")

    both_ways = checked.select(F.col("a").alias("z"), F.col("b").alias("c"), "n", "both").union(checked.select("b", "a", "m", "both"))
    offers = apart.join(both_ways, "z").unionByName(apart.select(
        "*", F.lit(None).cast("long").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("both")))
    up, down = 100 + percent, 100 - percent

    def least(m: Column, n: Column, both: Column) -> Column:
        delta = m + n - 2 * both
        return F.ceil((up * (delta - n + F.col("smallest")) - down * (m + F.col("smallest"))) / F.lit(2 * up)).cast("int")

    offers = offers.filter(least(F.col("m"), F.col("n"), F.col("both")) > 0)
    chosen = offers.groupBy("z", "smallest").agg(F.max(F.struct("both", "c")).alias("o")).select("z", "smallest", "o.c")

    whole = F.concat("common", "rare")
    z = sets.select(F.col("id").alias("z"), whole.alias("x"))
    c = sets.select(F.col("id").alias("c"), whole.alias("y"))
    outside = chosen.join(z, "z").join(c, "c", "left").withColumn("y", F.coalesce("y", F.array().cast("array<long>"))).select(
        "z", "smallest", F.array_except("x", "y").alias("own"), F.size("x").alias("m"), F.size("y").alias("n"))
    own = F.size("own")
    shown = F.greatest(F.lit(0), own - F.greatest(F.lit(1), least(F.col("m"), F.col("n"), F.col("m") - own)) + 1)
    held = sets.join(bounded_broadcast(written(centred.select("id").distinct(), "held"), BROADCAST_IDS), "id", "left_semi")
    held = held.select("id", whole.alias("x")).withColumn("n", F.size("x"))
    # What only one set holds finds none; it is shown first and needs no row.
    holders = held.select(F.explode("x").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    asked = outside.select("z", "m", own.alias("own"), shown.alias("shown"), F.explode("own").alias("shingle")).join(holders, "shingle")
    order = Window.partitionBy("z", "m", "own", "shown")
    asked = asked.withColumn("alone", F.col("own") - F.count(F.lit(1)).over(order)).withColumn(
        "place", F.col("alone") + F.row_number().over(order.orderBy("holders", "shingle")))
    wanted = written(asked.filter("place <= shown").select("z", "m", "own", "shingle", "place"), "wanted")
    found = held.select("id", "n", F.explode("x").alias("shingle")).join(bounded_broadcast(wanted, BROADCAST_IDS), "shingle")
    of_size = F.ceil((up * (2 * F.col("own") - F.col("m") + F.col("n")) - down * (F.col("m") + F.col("n"))) / F.lit(2 * up)).cast("int")
    met = found.filter(F.col("id") != F.col("z")).filter(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).filter(
        F.col("place") <= F.col("own") - F.greatest(F.lit(1), of_size) + 1).select(*_ends("id", "z")).distinct()
    labelled = met.join(component("a"), "a", "left").join(component("b"), "b", "left")
    return labelled.filter(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")


def jaccard_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Documents link when their sets of distinct word shingles reach ``percent`` per cent Jaccard similarity. Equal sets
    form a class (``class_id``: its smallest id); links are looked for between classes.

    1. Sizes and digests of all sets; classes by digest, combined in the map tasks.
    2. PartEnum signatures of one document per class, grouped by signature; each member is paired with the smallest
       set of its group, and the pairs are checked on whole sets.
    3. Groups that do not hang together by then: the rest is held against the centre of its group, and what still
       stands apart against the others by what it has beside a near set (``_outsiders``). Pairs inside a component need
       no check, they cannot change the result.

    Null or blank text: no set, linked with nothing, its own component. A null id: ``class_id`` and ``component_id``
    null, linked with nothing. Rows of one id count as one document that links through any of its texts. Very long
    texts are compared whole. Other columns are ignored. An empty table gives an empty result.
    """
    seen = written(_summaries(docs, words), "summaries")
    summaries = seen.filter("n_shingles is not null").select("doc_id", "n_shingles", "d1", "d2")
    full = summaries.filter("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = written(classes.select(F.col("class_id").alias("id")).distinct(), "representatives")

    common = _common_shingles(seen)
    shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))
    grouped = _groups(_met(_signed(docs, reps, words, percent, common, buckets), buckets))
    sets = written(_sets(docs, written(grouped.select("id").distinct(), "candidates"), words, common), "sets")
    first = written(grouped.filter("id <> first").select(*_ends("first", "id")).distinct(), "pairs")
    checked = written(_compared(first, sets, percent), "compared")
    linked = lambda df: df.filter("linked").select("a", "b")

    labels = written(components(linked(checked)), "labels")
    centred = written(_centres(grouped, labels, sets), "centred")
    second = centred.filter("id <> centre").select(*_ends("centre", "id")).distinct().join(first, ["a", "b"], "left_anti")
    checked = written(checked.union(_compared(written(second, "pairs"), sets, percent)), "compared")
    labels = written(components(linked(checked)), "labels")
    third = _outsiders(centred, labels, checked, sets, percent).join(checked, ["a", "b"], "left_anti")
    third = written(_possible(written(third, "pairs"), sets, percent), "possible")
    links = written(linked(checked).union(linked(_compared(third, sets, percent))), "links")
    if _ids_repeat(summaries):
        links = links.union(full.join(classes, ["n_shingles", "d1", "d2"]).filter("doc_id <> class_id").select(
            F.col("class_id").alias("a"), F.col("doc_id").alias("b")))
    reached = written(components(links), "components").select(F.col("id").alias("class_id"), "component")
    keyed = summaries.join(classes, ["n_shingles", "d1", "d2"], "left").withColumn(
        "class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    return keyed.join(reached, "class_id", "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _ids_repeat(summaries: DataFrame) -> bool:
    """Some id has several rows; then classes are tied together through it."""
    return summaries.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def report(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", "n_shingles", "component_id", "class_id")
