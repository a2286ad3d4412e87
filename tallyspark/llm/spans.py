"""Matches of a pattern with their places, in built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import bind

BLOCK = 128
_SPAN = "array<struct<start:long,end:long,match:string>>"


def running_sum(values: Column, block: int = BLOCK) -> Column:
    """Sum of all earlier elements at each place of an array of longs.

    Sums per block come first, so an element adds up at most one block and the block sums before it, and no array is
    copied per element.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)
    last = lambda arr, step: F.floor((F.size(arr) - 1) / step).cast("int")

    def offsets(arr):
        blocks = F.transform(F.sequence(F.lit(0), last(arr, block)), lambda b: total(F.slice(arr, b * block + 1, block)))
        return bind(blocks, lambda sums: F.transform(
            F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b))))

    def places(arr):
        return bind(offsets(arr), lambda before: F.transform(
            F.sequence(F.lit(0), F.size(arr) - 1),
            lambda i: F.get(before, F.floor(i / block).cast("int")) + total(F.slice(arr, i - i % block + 1, i % block))))

    return bind(values, lambda arr: F.when(F.size(arr) > 0, places(arr)).otherwise(F.array().cast("array<long>")))


def find(text: Column, pattern: str, block: int = BLOCK) -> Column:
    """All leftmost non-overlapping matches with start and end in code points, as an array; null text gives none.

    The pattern must not match the empty string. Pieces between matches and the matches themselves alternate, so their
    running lengths are the places; ``block`` is that of ``running_sum``.
    """
    def spans(found, pieces):
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found,
                             lambda piece, match: (F.length(piece) + F.length(match)).cast("long"))
        joined = F.zip_with(found, running_sum(lengths, block), lambda match, before: F.struct(match.alias("m"), before.alias("b")))
        return F.zip_with(joined, F.slice(pieces, F.lit(1), F.size(found)), lambda x, piece: F.struct(
            (x.b + F.length(piece)).alias("start"), (x.b + F.length(piece) + F.length(x.m)).alias("end"), x.m.alias("match")))

    def of(t):
        return bind(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("f"), F.split(t, pattern, -1).alias("p")),
                    lambda both: spans(both.f, both.p))

    return F.when(text.rlike(pattern), bind(text, of)).otherwise(F.array().cast(_SPAN))


def find_blocks(text: Column, pattern: str, block: int = 64) -> Column:
    """The matches of ``find`` in blocks: an array of (``at``, ``found``, ``pieces``), the place where a block starts, its
    matches and the text before each of them. ``placed`` gives the place of one match, so that only those that are kept
    are measured.
    """
    def blocks(found, pieces):
        part = lambda arr, b: F.slice(arr, b * block + 1, F.lit(block))
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")),
                            lambda b: F.struct(part(found, b).alias("found"), part(pieces, b).alias("pieces")))
        return bind(parts, lambda ps: F.zip_with(
            ps, running_sum(F.transform(ps, lambda x: (_width(x.found) + _width(x.pieces)).cast("long"))),
            lambda x, at: F.struct(at.alias("at"), x.found.alias("found"), x.pieces.alias("pieces"))))

    def of(t):
        return bind(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("f"), F.split(t, pattern, -1).alias("p")),
                    lambda both: blocks(both.f, both.p))

    return F.when(text.rlike(pattern), bind(text, of)).otherwise(F.array().cast("array<struct<at:long,found:array<string>,pieces:array<string>>>"))


def _width(parts: Column) -> Column:
    return F.length(F.array_join(parts, ""))


def placed(at: Column, found: Column, pieces: Column, i: Column) -> Column:
    """Start of match ``i`` (from 0) of a block of ``find_blocks``."""
    return at + _width(F.slice(pieces, F.lit(1), i + 1)) + _width(F.slice(found, F.lit(1), i))


def labelled(spans: Column, kind: str, place: int) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(spans, lambda s: F.struct(
        F.lit(place).alias("place"), F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.match.alias("match")))


def written_out(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
