"""Padding notes: exhausted texts, and the number after which they repeat."""

from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import money
from tallyspark.operators import generate


def _texts(spark, first, last):
    made = spark.range(first, last).select("id", generate.fill(generate.pick([t for t, _ in rules.PAD_PATTERNS], F.col("id")), m=money.money_text(F.col("id"))).alias("text"))
    return [r.text for r in made.orderBy("id").collect()]


def test_texts_repeat(spark):
    assert len(rules.PAD_PATTERNS) == 5 and _texts(spark, 0, 600) == _texts(spark, generate.PAD_NUMBERS, generate.PAD_NUMBERS + 600)


def test_every_text_is_found_before_padding_ends(spark, monkeypatch):
    monkeypatch.setattr(generate, "PAD_NUMBERS", 300)
    chosen = spark.createDataFrame([(1, "x", "Food")], "row_id BIGINT, text STRING, label STRING")
    got = generate.pad_notes(chosen, chosen.select("text"), 10_000)
    assert sorted(r.text for r in got.collect()) == sorted({"x", *_texts(spark, 0, 300)})
