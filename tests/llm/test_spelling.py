import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import spelling

from .conftest import odd_rows

SCHEMA = "doc_id long, text string, word string, n string, list string, head string"


def edits_one(a, b):
    """Whether exactly one inserted, deleted or replaced letter lies between two words; the plain matrix."""
    if max(len(a), len(b)) > 50:  # what is left between the common ends
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return (a[k + 1:] == b[k + 1:] or a[k + 1:] == b[k:] or a[k:] == b[k + 1:]) and a != b
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def brute(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and edits_one(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def texts(seed, docs=60, alphabet="abé"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 7))) for _ in range(150)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(150)], k=80)).replace("a", "A", 3)) for i in range(docs)]


def odd():
    rows = [r[:2] for r in odd_rows()] * 2 + texts(1)
    long = "abcde" * 4000
    rows += [(900, f"{long} {long} {long}"), (901, f"{long}x {long}x {long}x {long}x-{long}x {long}x"), (902, None), (None, "straße Straße STRASSE straßen " * 3)]
    return rows + [(903, "ÀÉÎÕÜ àéîõü ×÷øþÿ " * 4)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", "n", "l", "h") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("most", [spelling.LIST_WORDS, 4], ids=["whole", "cut"])
def test_variants_against_brute_force(spark, most):
    """With lists of four words at most, every list is cut down to one place."""
    rows = odd()
    got = [tuple(r) for r in spelling.variants(frame(spark, rows), most=most).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in want) > 20 and len({r[2] for r in want if r[1] not in (None, r[2])}) > 0


def test_matrix_rows_shared_by_prefixes():
    rng = random.Random(2)
    for size, letters in ((60, "ab"), (200, "abc"), (300, "abcdefgh")):
        groups = [sorted({head + "".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(size)}) for head in ("xy", "xz", "yy")]
        words = [w for g in groups for w in g]
        group = [k for k, g in enumerate(groups) for _ in g]
        for head in (0, 2):
            a, b = spelling.near_pairs(words, np.array(group), head)
            got = Counter((words[i], words[j]) for i, j in zip(a, b, strict=True))
            assert got == Counter((x, y) for g in groups for x in g for y in g if edits_one(x, y))


def test_empty_table(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
