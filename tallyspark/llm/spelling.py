"""Spelling variants by dynamic programming over sorted word lists that shares edit-matrix rows among common prefixes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_broadcast, written

MIN_CHARS = 5
MIN_COUNT = 3
#: A word whose near word is this many times as frequent is a variant of it.
RATIO = 2
#: Every so many (document, run) hashes one loses a character; the letter is hash modulo length.
DAMAGE = 97
#: Distinct words a task counts before it passes them on.
HELD_WORDS = 200_000
#: Words of one list; a larger group is cut into lists that share more letters.
LIST_WORDS = 20_000
#: Words and letters that are matched at once.
BATCH_WORDS, BATCH_LETTERS = 40_000, 4_000_000


def damaged(run: str, start: int) -> str:
    """The run, without one letter if the hash that goes on from ``start`` says so."""
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word``, ``n`` of the words of all whole texts with at least ``min_chars`` code points and ``min_count`` occurrences.

    The equal runs of a document are hashed once, and a task adds up the words of its documents, ``HELD_WORDS`` at a
    time, before anything is shuffled.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")  # a shorter run cannot become a word

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, int] = {}
        rows = lambda: pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes lower A-Z only
                    word = damaged(run, start)
                    if len(word) >= min_chars:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    found = docs.select("doc_id", "text").filter("text is not null").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _listed(rows: DataFrame) -> DataFrame:
    """Rows with the name of their list: the longer word's length, how many letters are shared at either end, and these."""
    ends = F.concat(F.expr("substring(word, 1, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("list", F.concat_ws(" ", "longer", "head", "tail", ends))


def _split(rows: DataFrame) -> DataFrame:
    """The two halves of what two words of a list may differ in: either the first half is equal or the rest is."""
    middle = F.col("longer") - F.col("head") - F.col("tail")
    half = F.floor(middle / 2).cast("int")
    ways = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
                   F.struct(F.col("head").alias("head"), (F.col("tail") + middle - half).alias("tail")))
    return rows.withColumn("way", F.explode(ways)).select("word", "n", "longer", F.col("way.head").alias("head"), F.col("way.tail").alias("tail"))


def lists(words: DataFrame, most: int = LIST_WORDS) -> list[DataFrame]:
    """Tables of ``word``, ``n``, ``longer``, ``head``, ``tail``, ``list`` in which every near pair meets in a list.

    Two near words differ at one place of the longer one, so its first half is in both or the rest is; each word is
    listed as the longer or as the shorter of a pair, by either half. A list above ``most`` words is cut by the same
    rule again, down to lists whose words differ in one given place, which hold a word per letter of the alphabet.
    """
    length = F.length("word")
    both = words.withColumn("longer", F.explode(F.array(length, length + 1)))
    rows = _split(both.select("word", "n", "longer", F.lit(0).alias("head"), F.lit(0).alias("tail")))
    done = []
    while True:
        rows = written(_listed(rows), "lists")
        large = written(rows.groupBy("list").count().filter((F.col("count") > most)).select("list"), "large")
        if large.head() is None:
            return [*done, rows]
        large = bounded_broadcast(large)
        final = F.col("longer") - F.col("head") - F.col("tail") <= 1
        again = rows.join(large, "list", "left_semi")
        done += [rows.join(large, "list", "left_anti"), again.filter(final)]
        rows = _split(again.filter(~final).drop("list"))


class _Words:
    """A sorted list of words as one array of code points, with the common prefix of every word and the one before it."""

    def __init__(self, words: list[str]) -> None:
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.at = np.cumsum(self.size) - self.size
        self.codes = np.append(self.codes, np.uint32(0))
        self.shared = np.zeros(len(words), dtype=np.int64)
        open_, depth = np.arange(1, len(words)), 0
        while len(open_):
            fits = (self.size[open_] > depth) & (self.size[open_ - 1] > depth)
            fits &= self.letter(open_, depth) == self.letter(open_ - 1, depth)
            open_ = open_[fits]
            depth += 1
            self.shared[open_] = depth

    def letter(self, word: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Code points at a place, 0 beyond either end."""
        inside = (place >= 0) & (place < self.size[word])
        return np.where(inside, self.codes[np.where(inside, self.at[word] + place, -1)], 0)


def near_pairs(words: list[str], group: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ordered pairs of words of one group that are one edit apart.

    ``words`` are sorted inside each group, groups are runs of equal numbers and the words of a group share ``head``
    letters at least. Every (query, range of list words with a common prefix) has one row of the edit matrix between
    that prefix and the query, in the band of one edit: the row is computed once for all words of the range and goes on
    to the subranges, which the common prefixes of neighbours delimit. A range whose row holds no value up to one is
    left, with all its words. All queries go down one letter at a time together.
    """
    table = _Words(words)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    table.shared[first] = -1  # nothing reaches over the border of a group
    ends = np.append(first[1:], len(words))
    mine = np.repeat(np.arange(len(first)), ends - first)
    query = np.arange(len(words))
    low, high = first[mine], ends[mine]
    more = high - low > 1
    query, low, high = query[more], low[more], high[more]
    # edit distance of the prefix of length depth to the query's first depth - 1, depth, depth + 1 letters
    left, here, right = (np.full(len(query), v, dtype=np.int8) for v in (1, 0, 1))
    left[:] = 1 if head else 2
    found, depth = ([], []), head
    while len(query):
        ended = np.flatnonzero(table.size[low] == depth)  # words that end here stand first in their range
        over = table.size[query[ended]] - depth
        value = np.select([over == -1, over == 0, over == 1], [left[ended], here[ended], right[ended]], 2)
        hit = ended[value == 1]
        found[0].append(query[hit])
        found[1].append(low[hit])
        low = low.copy()
        low[ended] += 1

        open_ = low < high
        query, low, high, left, here, right = (x[open_] for x in (query, low, high, left, here, right))
        borders = np.append(np.flatnonzero(table.shared <= depth), len(words))
        inner = np.searchsorted(borders, low, side="right")  # first border behind low
        parts = np.searchsorted(borders, high, side="left") - inner + 1
        row = np.repeat(np.arange(len(query)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.where(nth == 0, low[row], borders[inner[row] + nth - 1])
        end = borders[inner[row] + nth]

        query, letter = query[row], table.letter(start, depth)
        off = [(letter != table.letter(query, depth + k)).astype(np.int8) for k in (-1, 0, 1)]
        new_left = np.minimum(left[row] + off[0], here[row] + 1)
        new_here = np.minimum(np.minimum(here[row] + off[1], right[row] + 1), new_left + 1)
        new_right = np.minimum(right[row] + off[2], new_here + 1)
        depth += 1
        alive = np.minimum(np.minimum(new_left, new_here), new_right) <= 1
        query, low, high, left, here, right = (x[alive] for x in (query, start, end, new_left, new_here, new_right))
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)


def _matched(rows: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n`` of the near pairs in the lists of one table."""
    turned = F.col("tail") > F.col("head")  # scanned from the end that is shared
    rows = rows.select("list", "longer", F.greatest("head", "tail").alias("depth"), turned.alias("turned"), "n",
                       F.when(turned, F.reverse("word")).otherwise(F.col("word")).alias("word"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "list").sortWithinPartitions("longer", "list", "word")

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pairs(held: list) -> Iterator:
            names, longer, depth, turned, n, words = (np.concatenate([b[k] for b in held]) for k in range(6))
            group = np.cumsum(np.append(False, names[1:] != names[:-1]))
            kinds = np.cumsum(np.append(False, (longer[1:] != longer[:-1]) | (depth[1:] != depth[:-1]) | (turned[1:] != turned[:-1])))
            for kind in range(int(kinds[-1]) + 1):
                lo, hi = np.searchsorted(kinds, [kind, kind + 1])
                a, b = near_pairs(words[lo:hi].tolist(), group[lo:hi], int(depth[lo]))
                a, b = a + lo, b + lo
                size = np.fromiter(map(len, words[lo:hi]), dtype=np.int64, count=hi - lo)
                fits = np.maximum(size[a - lo], size[b - lo]) == longer[lo]  # two shorter words meet in lists of their own length
                a, b = a[fits], b[fits]
                back = (lambda x: x[::-1]) if turned[lo] else (lambda x: x)
                yield pa.record_batch([pa.array(map(back, words[a]), pa.string()), pa.array(map(back, words[b]), pa.string()), pa.array(n[b], pa.int64())],
                                      names=["word", "near", "near_n"])

        held, count, letters = [], 0, 0
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "longer", "depth", "turned", "n", "word")]
            held.append(got)
            count += batch.num_rows
            letters += int(got[1].sum())
            if count >= BATCH_WORDS or letters >= BATCH_LETTERS:
                whole = [np.concatenate([b[k] for b in held]) for k in range(6)]
                cut = int(np.flatnonzero(whole[0] == whole[0][-1])[0])  # the last list may go on
                if cut:
                    yield from pairs([[x[:cut] for x in whole]])
                held = [[x[cut:] for x in whole]]
                count, letters = len(held[0][0]), int(held[0][1].sum())
        if count:
            yield from pairs(held)

    return dealt.mapInArrow(match, "word string, near string, near_n long")


def near_words(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """``word``, ``near``, ``near_n``: every ordered pair of distinct words that differ by one inserted, deleted or
    replaced code point, once."""
    tables = [_matched(t) for t in lists(words, most)]
    pairs = tables[0]
    for more in tables[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for every word that has a form: the last word that forms lead to.

    A form is ``RATIO`` times as frequent as its word, so chains are as long as the logarithm of the largest count, and
    every round doubles how far all words look. A form has only its near words as followers, which bounds what meets at
    one key of the first join; later ones are split by Spark's skew join.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left"), "forms")
        if step.filter("next is not null").head() is None:
            return now
        now = step.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, most: int = LIST_WORDS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``docs`` (``doc_id``, ``text``).

    Words are runs of Latin letters with A-Z lowered, some with a letter left out as ``damaged`` says; a null ``doc_id``
    counts as the word null there. The form of a word is its most frequent near word (ties: smallest by code point) if
    that is ``ratio`` times as frequent. Lists of words that share half their letters are matched in one task each; a
    list is never larger than ``most`` words, or the number of letters there are. Null and empty texts have no words.
    Repeated rows count as often as they stand there. A word of any length is counted and matched whole. Other columns
    are ignored. An empty table gives no words.
    """
    words = written(word_counts(docs, min_chars, min_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")  # most frequent, then smallest
    named = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.less")
    chosen = form_n >= F.lit(ratio) * F.col("n")
    table = words.join(named, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, form_n).alias("form_n"))
    table = written(table, "table")
    roots = _followed(table.filter("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, 'null') || ':' AS head, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
     d AS (SELECT head, run, count(*) AS n, hex(encode(head || run)) AS b FROM r WHERE length(run) >= 5 GROUP BY head, run),
     h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 4 * length(b))), lambda c, k: list_transform(
             [xor(c, CASE WHEN k % 8 = 0 THEN (strpos('0123456789ABCDEF', substr(b, k // 4 + 1, 1)) - 1) * 16
                                              + strpos('0123456789ABCDEF', substr(b, k // 4 + 2, 1)) - 1 ELSE 0 END)],
             lambda y: xor(y >> 1, (y & 1) * 3988292384))[1]), 4294967295::BIGINT) AS h FROM d),
     w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
     v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
     m AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
     p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM m AS a JOIN m AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
           UNION SELECT v.word, m.word, m.n FROM v JOIN m ON m.rest = v.word
           UNION SELECT m.word, v.word, v.n FROM v JOIN m ON m.rest = v.word),
     f AS (SELECT word, count(*) AS n_near, arg_max(near, (near_n, -o)) AS near, max(near_n) AS near_n
           FROM (SELECT *, row_number() OVER (ORDER BY encode(near)) AS o FROM p) GROUP BY word),
     g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
           FROM v LEFT JOIN f USING (word)),
     c AS (SELECT word, word AS at FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.at AS root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word JOIN g AS last ON last.word = c.at AND last.form IS NULL
"""
