"""Statistics of whole texts, computed for many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

WINDOW = 8
CHUNK = 6_000_000
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_lines")


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word codes of all texts one after the other, the number of words of each text, and the words by code."""
    import pandas as pd

    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for words in split for w in words]
    found, unique = pd.factorize(flat)
    return found, counts, list(unique)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values."""
    n = len(values) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(width if n > 0 else 0):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[j:j + n] + np.uint64(j + 1))
    return out


def repeated_words(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text the words that lie in a window of ``WINDOW`` words found twice or more in that text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    runs = rolling(mixed(found.astype(np.uint64) + np.uint64(1)), WINDOW)
    if not len(runs):
        return np.zeros(len(counts), dtype=np.int64)
    at = np.flatnonzero(np.arange(len(runs)) + WINDOW <= ends[doc[:len(runs)]])
    _, place, n = np.unique(runs[at] ^ mixed(doc[at].astype(np.uint64) + np.uint64(7)), return_inverse=True, return_counts=True)
    twice = at[n[place] > 1]
    step = np.zeros(len(found) + 1, dtype=np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=len(counts))


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    seen, lines, again = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    return lines, again


def counts_of(texts: list[str]) -> np.ndarray:
    """One row of ``COUNTS`` per text. Words are runs without ASCII white space; lengths are in code points."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    found, n_words, _ = codes(raw)
    doc = np.repeat(np.arange(len(raw)), n_words)
    distinct = np.unique(doc * max(1, len(found)) + found) // max(1, len(found)) if len(found) else doc
    without = lambda chars: np.array([len(t) - len(t.translate(None, chars)) for t in raw], dtype=np.int64)
    lines = np.array([line_counts(t) for t in raw], dtype=np.int64).reshape(-1, 2)
    chars = np.array([len(t) for t in texts], dtype=np.int64)
    return np.column_stack([
        n_words, chars - without(_SPACES), without(_SYMBOLS), lines[:, 1], repeated_words(found, n_words),
        np.bincount(distinct, minlength=len(raw)), without(_UPPER), without(_DIGITS), lines[:, 0]])


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def with_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and ``COUNTS`` of the whole text; null counts as empty."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            table = np.concatenate([counts_of(part) for part in chunks(batch.column(3).to_pylist())] or [np.zeros((0, len(COUNTS)), np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c) for c in table.T]], ["doc_id", "lang", "source", *COUNTS])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"{n} {kinds[n]}" for n in ("doc_id", "lang", "source")] + [f"{n} long" for n in COUNTS])
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)
