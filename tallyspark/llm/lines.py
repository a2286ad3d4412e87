"""Line dedup by deletion neighbourhoods: equal variants join lines that one edit separates; the earliest stays."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import bind
from tallyspark.llm.common import bounded_broadcast, written

MIN_CHARS = 20
#: Code points of the middle part of a line in which deletions are tried at once.
BLOCK = 64
#: Documents with lines to spell that may be broadcast to find their texts; more are joined by a shuffle.
WANTED_ROWS = 100_000


def normal(line: Column) -> Column:
    """A line for comparison: without white space at the ends, runs of white space as one space."""
    runs = reduce(or_, [line.contains(x) for x in ("  ", "\t", "\r", "\x0b", "\x0c", "\n")])
    return F.trim(F.when(runs, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def frames(line: Column, n: Column) -> Column:
    """Four keys of a line: for its own length and one more, the hash of each outer half.

    Of two lines one edit apart, the longer one's first half or last half stands unchanged in the other. So a line that
    shares no frame with another line has no neighbour, and no variants of it are needed.
    """
    def of(total, place):
        front = F.floor(total / 2).cast("int")
        head = F.struct(F.lit(2 * place).alias("side"), total.alias("total"), F.substring(line, F.lit(1), front).alias("part"))
        back = (total - front).cast("int")
        tail = F.struct(F.lit(2 * place + 1).alias("side"), total.alias("total"), F.substring(line, n - back + 1, back).alias("part"))
        return [head, tail]

    keys = F.array(*of(n, 0), *of(n + 1, 1))
    return F.transform(keys, lambda k: F.xxhash64(k.side % 2, k.total, k.part))


def blocks(line: Column, n: Column, block: int = BLOCK) -> Column:
    """The line cut into blocks, for its own length and for one more: ``low``, ``size``, ``short`` (1 for the larger
    length, whose block is one short already), ``middle`` (the block) and ``r1``, ``r2`` (hashes of what stands around it).

    Lines one edit apart agree around the block of the edit, so only blocks with equal surroundings need variants.
    """
    def around(total):
        def one(b):
            low = (b * block).cast("int")
            size = F.least(F.lit(block), total - low).cast("int")
            short = (total - n).cast("int")
            before, after = F.substring(line, F.lit(1), low), F.substring(line, low + size - short + 1, n)
            return F.struct(
                low.alias("low"), size.alias("size"), short.alias("short"), F.substring(line, low + 1, size - short).alias("middle"),
                F.xxhash64(total, low, before, after).alias("r1"), F.hash(total, low, before, after).alias("r2"))

        return F.transform(F.sequence(F.lit(0), F.floor((total - 1) / block).cast("int")), one)

    return F.concat(around(n), around(n + 1))


def variants(frame: Column) -> Column:
    """All variants of a block within one deletion, as (``k1``, ``k2``, ``place``): what stands around the block and the
    block with one character left out, hashed. A block that is one short already is its own variant, ``place`` -1.

    ``k1`` and ``k2`` are of different families, 96 bits together; chance agreement is left to the check of the distance.
    """
    def row(text, place):
        return F.struct(F.xxhash64(frame.r1, text).alias("k1"), F.hash(frame.r2, text).alias("k2"), place.cast("int").alias("place"))

    cut = F.transform(F.sequence(F.lit(0), frame.size - 1), lambda i: row(
        F.concat(F.substring(frame.middle, F.lit(1), i), F.substring(frame.middle, i + 2, frame.size)), frame.low + i))
    return F.when(frame.short == 1, F.array(row(frame.middle, F.lit(-1)))).otherwise(cut)


def split_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``at`` (row and ``line_no`` from 0) and ``line`` (normal form) of the lines of at least ``min_chars`` code points."""
    lines = docs.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    lines = lines.select(F.struct("row", "line_no").alias("at"), F.explode(F.array(normal(F.col("raw")))).alias("line"))
    return lines.filter(F.length("line") >= min_chars)


def repeated_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``at`` of every line that an earlier line of the corpus equals or is one edit away from.

    ``docs``: ``row``, ``text``. Equal lines meet by digest and shrink in the map tasks. Of the different lines only
    those that share a frame with another are cut into blocks, and of these only those with the surroundings of another
    line's block are spelled into variants. Lines that share a variant are one edit apart if
    they left out the same place, or if one of them left out nothing; so the earliest line per variant and place, and
    per variant of the shorter line, is found by aggregation and no pair within a group is emitted. What a line is
    paired with is its earliest partner; the distance of that pair is checked on the texts.
    """
    lines = split_lines(docs, min_chars)
    hashed = lines.select("at", F.unhex(F.md5("line")).alias("digest"),
                          *([frames(F.col("line"), F.length("line")).alias("frames")] if max_edits else []))
    hashed = written(hashed, "lines")
    first = hashed.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = hashed.select("digest", "at").join(first.filter("n > 1").drop("n"), "digest").filter(F.col("at") != F.col("first")).select("at")
    if not max_edits:
        return equal

    single = hashed.join(first.select("digest", "first"), "digest").filter(F.col("at") == F.col("first"))
    single = single.select("digest", "at", F.explode(F.array_distinct("frames")).alias("frame"))
    shared = single.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("frame")
    open_lines = written(single.join(shared, "frame", "left_semi").select("at").distinct(), "open-lines")

    wanted = open_lines.groupBy(F.col("at.row").alias("row")).agg(F.collect_list("at.line_no").alias("nos"))
    wanted = bounded_broadcast(written(wanted, "wanted"), WANTED_ROWS)
    texts = docs.join(wanted, "row").select("row", F.explode("nos").alias("line_no"), F.split("text", "\n", -1).alias("all"))
    texts = texts.select(F.struct("row", "line_no").alias("at"), normal(F.get("all", F.col("line_no"))).alias("line"))
    texts = written(texts.dropDuplicates(["at"]), "open-texts")

    around = written(texts.select("at", F.explode(blocks(F.col("line"), F.length("line"))).alias("f")).select("at", "f.*"), "blocks")
    meeting = around.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r1", "r2")
    frame = F.struct("low", "size", "short", "middle", "r1", "r2")
    spelled = around.join(meeting, ["r1", "r2"], "left_semi").select("at", F.explode(bind(frame, variants)).alias("v")).select("at", "v.*")
    spelled = written(spelled, "variants")
    same = spelled.groupBy("k1", "k2", "place").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    same = written(same, "variant-firsts")
    crowd = same.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("place") < 0, F.col("first"))).alias("short"),
        F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("long"),
        F.sum("n").alias("all")).filter("all > 1").drop("all")
    alike = same.filter("n > 1 and place >= 0").select("k1", "k2", "place", "first")
    near = spelled.join(crowd, ["k1", "k2"]).join(alike, ["k1", "k2", "place"], "left")
    partner = F.when(F.col("place") < 0, F.col("long")).otherwise(F.least("first", "short"))
    pairs = near.select("at", partner.alias("before")).filter(F.col("before") < F.col("at"))
    pairs = written(pairs.distinct(), "line-pairs")
    left = texts.select("at", F.col("line").alias("a"))
    right = texts.select(F.col("at").alias("before"), F.col("line").alias("b"))
    close = pairs.join(left, "at").join(right, "before").filter(F.levenshtein("a", "b", max_edits).between(0, max_edits))
    later = hashed.select("digest", "at").join(close.select("at").distinct(), "at", "left_semi").select("digest")
    return hashed.select("at", "digest").join(later, "digest", "left_semi").select("at").union(equal).distinct()


def placed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``row``: their order (id, null last, then a hash of the text) and key in one."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("text"))
    return docs.select(row.alias("row"), "doc_id", "text", F.struct(F.lit(0), *carry).alias("carried"))


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` without repeated lines, ``n_lines``, ``n_dropped`` and the ``carry`` columns of every row.

    Lines are parts between newlines in normal form (``normal``). A line of at least ``min_chars`` code points goes if
    an earlier one of the corpus (by ``doc_id``, then line) equals it or, with ``max_edits`` 1, is one inserted, left
    out or changed character away; shorter lines stay. The earliest line always stays; what is close only to a line
    that goes itself still goes. Kept lines are written as they were.

    Null text stays null, with 0 lines. Null ids come after all others. Rows of one id are ordered by a hash of their
    texts; rows that repeat id and text are one document and get the same result. Very long lines are compared whole.
    Other columns are ignored. An empty table gives an empty result. Python is not used.
    """
    if max_edits not in (0, 1) or min_chars < 2:
        raise ValueError("max_edits is 0 or 1 and min_chars at least 2")
    rows = placed(docs, carry)
    gone = repeated_lines(rows.select("row", "text"), max_edits, min_chars)
    gone = gone.groupBy("at.row").agg(F.collect_set("at.line_no").alias("gone"))
    kept = bind(F.struct(F.split("text", "\n", -1).alias("lines"), F.col("gone").alias("gone")), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x.lines) - 1), x.gone), lambda i: F.get(x.lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return rows.join(gone, "row", "left").select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n_lines.alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), *[F.col("carried")[c].alias(c) for c in carry])


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
     x AS (SELECT doc_id, unnest(raw) AS raw, unnest(range(len(raw))) AS line_no FROM d WHERE text IS NOT NULL),
     l AS (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM x),
     u AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS pos FROM l WHERE length(line) >= 20 GROUP BY line),
     f AS (SELECT line, n, pos, unnest([n, n, n + 1, n + 1]) AS total, unnest([0, 1, 0, 1]) AS side FROM u),
     k AS (SELECT *, CASE side WHEN 0 THEN left(line, total // 2) ELSE right(line, total - total // 2) END AS part FROM f),
     g AS (SELECT DISTINCT b.line FROM k a JOIN k b USING (total, side, part)
           WHERE a.pos < b.pos AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
     m AS (SELECT l.*, coalesce(g.line IS NOT NULL OR (u.pos IS NOT NULL AND u.pos <> {'d': doc_id, 'l': line_no}), false) AS gone
           FROM l LEFT JOIN u USING (line) LEFT JOIN g USING (line)),
     t AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text,
                  count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN t USING (doc_id)
"""
