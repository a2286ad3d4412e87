"""Chains over receipts: boxes are read once, and the forms for small receipts give the rows of the general ones."""

import random

import pytest

from tallyspark.operators import receipts, scan
from tallyspark.plans import catalog
from tallyspark.views import Inputs

SMALL = "/root/testdata/sf0.001"
BOXES = "receipt_id BIGINT, box_id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT, text STRING, conf DOUBLE"


@pytest.fixture(scope="module")
def pages(spark):
    """Pages on which names compete for prices, with rows that touch, gaps and odd heights."""
    draw, rows = random.Random(7), []
    for receipt in range(40):
        for box in range(draw.randint(0, 30)):
            price = draw.random() < 0.45
            x, y, h = (700 if price else draw.choice([20, 300])), draw.randint(0, 400), draw.choice([8, 24, 60])
            rows.append((receipt, box, x, y, x + 90, y + h, f"{draw.randint(1, 99)}.000" if price else f"{draw.choice(['banh mi', 'ca phe', 'gao'])} {box}", 0.5))
    return spark.createDataFrame(rows, BOXES).cache()


def test_items_of_small_receipts(pages):
    joined = receipts.match_items(pages).drop("name_id")
    folded = receipts.match_items(pages, small=True).drop("name_id")
    want, got = sorted(map(tuple, joined.collect())), sorted(map(tuple, folded.collect()))
    assert got == want and len({r[3] for r in got if r[3]}) > 20 and any(r[3] == 0 for r in got)


def test_boxes_of_crowded_receipts(spark):
    usual, crowded = Inputs(spark, SMALL), Inputs(spark, SMALL)
    crowded.__dict__["crowded"] = True
    assert not usual.crowded and usual.small
    assert sorted(map(tuple, usual.R.collect())) == sorted(map(tuple, crowded.R.collect()))


def test_width_counts_only_full_buckets(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 300 THEN 7 ELSE id END AS k")
    assert scan.width_for(rows, "k", 300) is None and scan.width_for(rows, "k", 299) == scan.BANDS


def test_summary_reads_the_items_once(spark):
    plan = catalog.QUERIES["f33_receipt_confidence"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


def test_totals_reconciled_by_scans(pages):
    from pyspark.sql import functions as F
    rows = pages.withColumn("text", F.expr("CASE WHEN box_id % 5 = 0 THEN 'Tong cong' WHEN x1 = 700 THEN concat(1 + box_id % 3, '.000') ELSE text END"))
    rows = rows.withColumn("entity", F.expr("CASE WHEN box_id % 2 = 0 THEN 'TOTAL_COST' ELSE 'OTHER' END"))
    totals = rows.select("receipt_id").distinct().withColumn("amount", (1 + F.col("receipt_id") % 3) * 1000)
    scans, joins = receipts.reconcile_total(rows, totals), receipts.reconcile_total(rows, totals, 4)
    want = sorted(map(tuple, joins.select("receipt_id", "box_id", "entity").collect()))
    assert sorted(map(tuple, scans.select("receipt_id", "box_id", "entity").collect())) == want
    assert {e for _, _, e in want} == {"TOTAL_COST", "OTHER"}
    plan = scans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # the totals; every other step stays with the receipt


def test_lexicon_reads_a_line_once(spark):
    lines = spark.createDataFrame([(1, 1, "com"), (1, 2, "ca"), (1, 3, "phe sua"), (1, 4, "ca phe"), (2, 1, "hoa don ca phe")], "receipt_id BIGINT, line_no BIGINT, line STRING")
    frame = receipts.lexicon_scores(lines)
    from tallyspark import rules
    lows = {1: ["com", "ca", "phe sua", "ca phe"], 2: ["hoa don ca phe"]}
    want = set()
    for receipt, texts in lows.items():
        for category, words in rules.CATEGORY_KEYWORDS.items():
            score = sum(w in " ".join(texts) for w in words) + 3 * sum(w in t for t in texts for w in words if "hoa don" not in t)
            if score:
                want.add((receipt, category, score))
    assert set(map(tuple, frame.collect())) == want and want
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("explode(") == 0


def test_words_are_neither_sorted_nor_sent(spark, pages):
    from pyspark.sql import functions as F
    words = receipts.box_words(pages, F.expr("CASE WHEN box_id % 3 = 0 THEN 'TOTAL_COST' ELSE 'O' END"))
    wide = receipts.box_words(pages, F.expr("CASE WHEN box_id % 3 = 0 THEN 'TOTAL_COST' ELSE 'O' END"), 4)
    got = sorted(map(tuple, words.collect()))
    assert got == sorted(map(tuple, wide.collect()))
    assert [r[1] for r in got if r[0] == got[0][0]] == list(range(1, sum(r[0] == got[0][0] for r in got) + 1))
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and plan.index("posexplode") < plan.index("Window ")  # words spread above the only sort
    near, far = receipts.limit_totals(words, small=True), receipts.limit_totals(words)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def test_texts_of_items_are_read_once(spark, pages):
    """Patterns and keywords run over the different texts, not in the plan over boxes, items and lines."""
    from pyspark.sql import functions as F
    items = receipts.match_items(pages, small=True)
    named = receipts.item_categories(items)
    lines = pages.select("receipt_id", (F.col("box_id") + 1).alias("line_no"), F.col("text").alias("line"))
    rows = receipts.expense_rows(lines, named.groupBy("receipt_id").agg(F.sum("price").alias("amount"), F.max("category").alias("category")))
    plans = [df._jdf.queryExecution().optimizedPlan().toString().lower() for df in (items, named, rows)]
    assert not any(word in plan for plan in plans for word in ("rlike", "regexp", "contains(name"))
    assert rows.count() == lines.filter("line_no <= 6").select("receipt_id").distinct().count()


def test_annotations_of_small_receipts_stay_with_the_receipt(spark, pages):
    boxes = pages.repartition(3, "receipt_id")
    segs = boxes.selectExpr("receipt_id", "box_id AS seg_id", "x1 - 5 AS sx1", "y1 - 4 AS sy1", "x2 + 60 AS sx2", "y2 + 9 AS sy2",
                            "CASE box_id % 3 WHEN 0 THEN 'SELLER' WHEN 1 THEN 'TIMESTAMPS' ELSE 'O' END AS label").filter("seg_id % 4 <> 1")
    near, far = receipts.match_annotations(boxes, segs, small=True), receipts.match_annotations(boxes, segs)
    want = sorted(map(tuple, far.collect()), key=str)
    assert near.columns == far.columns and sorted(map(tuple, near.collect()), key=str) == want
    assert {r[-1][:2] for r in want} == {"B-", "I-", "O"} and any(r[-3] != r[1] for r in want)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert all(part.startswith("receipt_id") for part in plan.split("hashpartitioning(")[1:])
    assert "_band" in far._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(", 1)[1]
