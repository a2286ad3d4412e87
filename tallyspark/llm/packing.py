"""Hierarchical packing of documents into windows of several lengths, without padding but for one window per task."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tallyspark.llm import tokens

#: Window lengths, longest first; powers of two.
TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 64 * 1024
#: Documents' rests that are packed together.
POOL = 8192
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "window long, step_group long")


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The shortest window that holds ``length``."""
    return next(t for t in reversed(tiers) if t >= length)


def pack_pool(lengths: list[int], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Packs rests shorter than the longest window: (windows, left).

    A window is (length, [(rest, from, to)]) and full. The longest rest opens a window of its tier; its gap takes the
    longest rest that fits, again and again, and at last the head of the shortest one that does not fit. When no rest
    is left, what stands in the unfinished window goes into shorter windows that it fills, and the end that fills none
    is returned as ``left``.
    """
    pool = sorted((n, i, 0) for i, n in enumerate(lengths) if n)
    windows = []
    while pool:
        n, i, at = pool.pop()
        window = tier_of(n, tiers)
        inside, gap = [(i, at, at + n)], window - n
        while gap and pool:
            k = bisect_right(pool, (gap, float("inf"), 0)) - 1
            if k >= 0:
                n, i, at = pool.pop(k)
                inside.append((i, at, at + n))
                gap -= n
            else:
                n, i, at = pool.pop(0)
                inside.append((i, at, at + gap))
                insort(pool, (n - gap, i, at + gap))
                gap = 0
        if not gap:
            windows.append((window, inside))
            continue
        for window in tiers:
            while sum(b - a for _, a, b in inside) >= window:
                head, rest, room = [], [], window
                for i, a, b in inside:
                    cut = min(b, a + room)
                    if cut > a:
                        head.append((i, a, cut))
                        room -= cut - a
                    if b > cut:
                        rest.append((i, cut, b))
                windows.append((window, head))
                inside = rest
        return windows, inside
    return windows, []


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool: int = POOL,
         with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, ``window`` and ``step_group``, with ``ids`` (bytes of unsigned 32-bit ids) if asked for.

    A document's ids (with the end id) are cut into whole windows of the longest tier; the rest is routed to the tier
    that holds it and packed by ``pack_pool`` with up to ``pool`` other rests of its task. The rest that fills no window
    moves on to the next pool, so only the last sequence of a task is padded. A step group holds sequences of one
    window length and ``step_tokens`` tokens, so groups weigh the same; a task leaves at most one open group per tier.

    Packing needs no shuffle: a task packs what it reads, in memory bounded by the pool. Sequence and group ids start
    with the task's number; they follow from the split of the input, so a repeated task gives the same rows.

    Null or empty text: the end id alone. Null and repeated ids are allowed, each row is packed for itself. Other
    columns are ignored. A text of any length is cut into as many whole windows as it fills; of rests of one length the
    later one of the task is taken first. An empty table gives an empty result.
    """
    longest = tiers[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        size = tokens.Encoder.of(path).size
        sequence = 0
        steps = dict.fromkeys(tiers, 0)
        out: list[tuple] = []
        rests: list[tuple] = []

        def emit(window: int, pieces: list[tuple]) -> None:
            nonlocal sequence
            group = steps[window] // max(1, step_tokens // window)
            steps[window] += 1
            offset = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // size
                ids = tokens.wide(ids, size)
                row = (doc_id, start, n, zlib.crc32(ids), total, (task << 36) + sequence, offset, window,
                       (((task << 4) + tiers.index(window)) << 28) + group)
                out.append((*row, ids) if with_ids else row)
                offset += n
            sequence += 1

        def pack_rests(last: bool) -> list[tuple]:
            windows, left = pack_pool([len(r[2]) // size for r in rests], tiers)
            part = lambda i, a, b: (rests[i][0], rests[i][1] + a, rests[i][2][size * a:size * b], rests[i][3])
            for window, inside in windows:
                emit(window, [part(*x) for x in inside])
            kept = [part(*x) for x in left]
            if last and kept:
                emit(longest, kept)
            return kept

        def flush() -> Iterator:
            if out:
                names = [f.split()[0] for f in _PIECES.split(", ")] + ["ids"] * with_ids
                kinds = [pa.int64()] * 9 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out.clear()

        for doc_ids, encoded, _ in tokens.encoded(batches, path):
            for doc_id, ids in zip(doc_ids, encoded):
                view, total = memoryview(ids), len(ids) // size
                for at in range(0, total - longest + 1, longest):
                    emit(longest, [(doc_id, at, view[size * at:size * (at + longest)], total)])
                if total % longest:
                    at = total - total % longest
                    rests.append((doc_id, at, bytes(view[size * at:]), total))
            if len(rests) >= pool:
                rests = pack_rests(False)
            if len(out) >= 4096:
                yield from flush()
        pack_rests(True)
        yield from flush()

    schema = _PIECES + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
