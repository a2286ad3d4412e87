"""Texts that repeat one short group a hundred thousand times."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pii, secrets, spans

GROUPS = {"hyphens": "a-" * 100_000 + "b", "apostrophes": "x'" * 100_000, "domains": "joe@" + "a." * 100_000 + "com", "local": "a." * 100_000 + "@b.co",
          "digits": "1 " * 100_000, "run": "7" * 100_000, "numbers": "1." * 100_000 + "2", "phone": "+1" + "(2)" * 100_000, "plus": "+" * 100_000,
          "hex": "0a" * 100_000, "keys": "token=" * 50_000 + "abcdefgh", "access": "AKIA" * 50_000}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(GROUPS.items()), "name string, text string").repartition(4)


def test_patterns_do_not_recurse(texts):
    got = {r["name"]: r for r in texts.select("name", F.size(spans.find(F.col("text"), pii.TERM)).alias("terms"),
                                              F.transform(pii.base_spans(F.col("text")), lambda s: F.struct(s.kind, s.start, s.end)).alias("s")).collect()}
    term = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
    assert {n: r.terms for n, r in got.items()} == {n: len(term.findall(t)) for n, t in GROUPS.items()}
    assert [tuple(s) for s in got["domains"].s] == [("email", 0, len(GROUPS["domains"]))] and [tuple(s) for s in got["local"].s] == [("email", 0, len(GROUPS["local"]))]


def test_secrets_in_long_texts(texts):
    docs = texts.withColumns({"doc_id": F.xxhash64("name"), "lang": F.lit("en"), "source": F.lit("s")})
    assert secrets.report(secrets.scan_secrets(docs)).count() == len(GROUPS)


def test_places_of_marked_words_only(spark):
    """Places are those of all words, in any block, beside letters outside the basic plane, in empty and null texts."""
    texts = ["", None, "...", "one", " ".join(f"w\U0001F600 wort{i % 7} É{i}\n" for i in range(150)), "A-b-c " * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    words = rows.select("row", F.explode(pii.words_at(F.col("text"))).alias("w")).select("row", F.lower("w.match").alias("term"), "w.start", "w.end")
    marks = words.filter("term in ('one', 'wort3', 'é149', 'a-b-c')").select(F.xxhash64("term").alias("mark")).distinct()
    got = pii.marked_words(rows, marks)
    want = sorted(map(tuple, words.join(marks, F.xxhash64("term") == F.col("mark"), "left_semi").collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
