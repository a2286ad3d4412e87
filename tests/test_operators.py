import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.functions import money
from tallyspark.functions import text as tx
from tallyspark.operators import baseline, curate, dedupe, evaluate, ledger, ordering, receipts, sample, scan, similarity, stats
from tallyspark.views import Inputs

SMALL = "/root/testdata/sf0.001"
COUNTS = [
    ("expense", "Essentials", 14591), ("expense", "Food", 13353), ("expense", "Entertainment", 8845), ("expense", "Transport", 4896),
    ("expense", "Shopping", 4808), ("expense", "Housing", 4254), ("expense", "Beauty", 4052), ("expense", "Education", 3850),
    ("expense", "Health", 3748), ("expense", "Social", 3738), ("expense", "Investment", 3511), ("expense", "Debt", 3339),
    ("expense", "Charity", 3295), ("expense", "Savings", 3076), ("expense", "Others", 672), ("expense", "Business", 72),
    ("expense", "Salary", 9), ("expense", "Bonus", 2), ("income", "Business", 4986), ("income", "Bonus", 4461),
    ("income", "Salary", 3698), ("income", "Investment", 224), ("income", "Savings", 112), ("income", "Debt", 27),
]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_balance_analysis(spark):
    pairs = spark.createDataFrame(COUNTS, "type STRING, label STRING, n BIGINT")
    got = stats.stats_from_counts(pairs).first()
    assert (got.expense, got.income, got.median_label_count, got.target_per_label) == (80111, 13508, 3951.0, 3358)
    assert (got.expense_income_ratio, got.income_target, got.income_gap) == (5.93, 14419, 911)
    weak = [(r["label"], r["gap"], r["type"]) for r in stats.weak_from_counts(pairs).collect()]
    assert weak == [("Others", 2686, "expense"), ("Savings", 170, "income"), ("Charity", 63, "expense")]


def test_dedupe_is_idempotent_and_plans_a_group_limit(spark):
    u = Inputs(spark, SMALL).U
    once = dedupe.dedupe_masked(u)
    assert rows(once, "row_id") == rows(dedupe.dedupe_masked(once), "row_id")
    assert "WindowGroupLimit" in once._jdf.queryExecution().toString()


def test_route_split_is_disjoint_and_complete(spark):
    u = Inputs(spark, SMALL).U
    kept, removed = curate.split_action_like(u)
    assert kept.count() + removed.count() == u.count() and removed.count() > 0
    assert kept.join(removed, "row_id", "left_semi").count() == 0


def test_micro_recall_is_accuracy(spark):
    y = Inputs(spark, SMALL).Y
    got = evaluate.averages(y).first()
    assert math.isclose(got.weighted_recall, got.accuracy)


def test_exact_percentile(spark):
    rng = random.Random(3)
    data = [("a", rng.random()) for _ in range(997)] + [("b", float(rng.randint(0, 5))) for _ in range(400)] + [("c", 1.5)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    got = {r["k"]: r["percentile"] for r in evaluate.exact_percentile(df, ["k"], "v", 0.95).collect()}
    for key in "abc":
        assert math.isclose(got[key], np.percentile([v for k, v in data if k == key], 95), rel_tol=1e-12)


def test_ranks_in_skewed_groups(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    for ranked in (ordering.rank_by_draw(df, "k", rank="r"), ordering.rank_by_id(df, "k", rank="r", buckets=16)):
        per = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r").alias("d"), F.min("r").alias("a"), F.max("r").alias("b")).collect()
        assert all((p.n, 1, p.n) == (p.d, p.a, p.b) for p in per)
    top = ordering.first_k(df, "k", ["row_id"], 3)
    assert sorted(r.row_id for r in top.filter("k = 'hot'").collect()) == [0, 3, 6]


def test_splits_and_quotas(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("label"))
    split = sample.stratified_split(df, "label")
    assert split.filter("split = 'train'").count() == 800
    quotas = spark.createDataFrame([("a", 1, 5), ("b", 2, 3), ("c", 3, 2)], "key STRING, pos INT, quota INT")
    assert sum(r.quota for r in sample.scale_quotas(quotas, 77).collect()) == 77
    assert [r.quota for r in sample.scale_quotas(quotas, 2).orderBy("pos").collect()] == [1, 1, 0]
    grown = sample.oversample(df, "label", 1, F.lit(600))
    assert grown.filter("label = 1").count() == 600 and grown.filter("label <> 1").count() == 750


# --- receipts against brute force ------------------------------------------------------------------
def random_boxes(seed, receipts_=6, boxes=40):
    rng = random.Random(seed)
    out = []
    for r in range(receipts_):
        for b in range(boxes):
            x, y = rng.randint(0, 700), rng.randint(0, 900)
            text = rng.choice(["banh mi", "ca phe sua", "loai", "12.000", "30.000", "tra xanh", "5.500", "gao"])
            out.append((r, b, x, y, x + rng.randint(20, 120), y + rng.randint(0, 40), text, rng.choice([0.5, 0.75, 1.0])))
    return out


BOXES = "receipt_id BIGINT, box_id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT, text STRING, conf DOUBLE"


def brute_merge(boxes):
    """Straight reading of the rule on one receipt."""
    open_rows = []
    for box in sorted((b for b in boxes if b[5] > b[3]), key=lambda b: (b[3], b[2], b[1])):
        for row in open_rows:
            ref = row[0]
            h = min(box[5] - box[3], ref[5] - ref[3])
            shared = max(0, min(box[5], ref[5]) - max(box[3], ref[3]))
            if shared >= h * 0.5 or abs((box[3] + box[5]) - (ref[3] + ref[5])) / 2 < h * 0.4:
                row.append(box)
                break
        else:
            open_rows.append([box])
    merged = []
    for row in open_rows:
        done = []
        for b in sorted(row, key=lambda b: (b[2], b[3], b[1])):
            if done and b[2] - done[-1][2] <= (done[-1][3] - done[-1][1]) * 1.8:
                p = done[-1]
                done[-1] = (min(p[0], b[2]), min(p[1], b[3]), max(p[2], b[4]), max(p[3], b[5]), p[4] + " " + b[6], (p[5] + b[7]) / 2)
            else:
                done.append((b[2], b[3], b[4], b[5], b[6], b[7]))
        merged += done
    return merged


def test_merge_fragments(spark):
    data = random_boxes(1)
    df = spark.createDataFrame(data, BOXES)
    expected = sorted((r, *m) for r in range(6) for m in brute_merge([b for b in data if b[0] == r]))
    for width in (None, 100):
        got = receipts.merge_fragments(df, width=width)
        assert sorted(tuple(r) for r in got.drop("box_id").collect()) == expected


def test_match_items_is_greedy(spark):
    df = spark.createDataFrame(random_boxes(2, 5, 60), BOXES)
    names, prices = receipts.names_and_prices(df)
    names, prices = names.collect(), prices.collect()
    expected = {}
    for r in range(5):
        taken = set()
        for n in sorted((n for n in names if n.receipt_id == r), key=lambda n: (n.ny1, n.name_id)):
            free = [(math.hypot(p.px - n.nx, p.py - n.ny), p.price_id, p.amount) for p in prices
                    if p.receipt_id == r and p.price_id not in taken and p.px > n.nx and abs(p.py - n.ny) < 1.5 * n.h]
            expected[r, n.name_id] = 0
            if free:
                _, price, amount = min(free)
                taken.add(price)
                expected[r, n.name_id] = amount
    for width in (None, 64):
        got = {(r.receipt_id, r.name_id): r.price for r in receipts.match_items(df, width=width).collect()}
        assert got == expected
    assert any(expected.values())


def test_banded_scans_equal_plain_windows(spark):
    df = spark.createDataFrame(random_boxes(4, 3, 80), BOXES)
    plain = rows(receipts.group_lines(df), "receipt_id", "line_no")
    assert rows(receipts.group_lines(df, width=50), "receipt_id", "line_no") == plain
    labelled = rows(receipts.label_boxes(df), "receipt_id", "box_id")
    assert rows(receipts.label_boxes(df, width=50), "receipt_id", "box_id") == labelled
    words = receipts.box_words(df, F.lit("TIMESTAMP"))
    assert rows(receipts.limit_timestamps(words, width=16), "receipt_id", "pos") == rows(receipts.limit_timestamps(words), "receipt_id", "pos")
    assert scan.width_for(df, "receipt_id", limit=10) == scan.BANDS and scan.width_for(df, "receipt_id") is None


def test_total_fallbacks(spark):
    lines = [(1, 1, "cua hang"), (1, 2, "banh 2 15.000 15.000"), (1, 3, "sua 1 20.000 20.000"), (2, 1, "x"), (2, 2, "45.000"),
             (2, 3, "y 70.000"), (3, 1, "thanh toan 12.000"), (3, 2, "banh 30.000 30.000"), (4, 1, "Tong cong 80.000")]
    df = spark.createDataFrame(lines, "receipt_id BIGINT, line_no BIGINT, line STRING")
    assert rows(receipts.total_amount(df), "receipt_id") == [(1, 35000), (2, 70000), (3, 30000), (4, 80000)]


# --- similarity ------------------------------------------------------------------------------------
def plain_words(spark, texts):
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "text STRING")
    return {r.text: r.w.split() for r in df.select("text", similarity.normal_text(F.col("text")).alias("w")).collect()}


def plain_grams(words):
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_similar_corrections(spark):
    """Against plain cosines over every pair of one user; unknown grams weigh most and count in the norm."""
    rng = random.Random(4)
    words = ["mua", "gạo", "ngon", "ở", "chợ", "đầu", "mối", "xe", "ôm", "về", "nhà", "phim"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    corpus = [sentence(rng.randint(1, 6)) for _ in range(80)] + ["gạo", "gạo", "mua gạo"]
    fixes = [(1, 7, "gạo"), (2, 7, "Mua gạo ở chợ "), (3, 7, "mua gạo ở chợ"), (4, 8, "mua gạo ở chợ"), (5, 7, ""), (6, 7, None), (7, 7, "xe ôm về nhà")]
    fixes += [(20 + i, rng.choice([7, 8]), sentence(rng.randint(2, 7))) for i in range(60)]
    log = [(10, 7, "gạo hoàng kim thượng hạng"), (11, 7, "mua gạo ở chợ 50k"), (12, 9, "gạo"), (13, 7, None), (14, 7, "50k"), (15, 8, "mua gạo chợ"), (16, 7, "xe ôm về nhà nhà")]
    log += [(100 + i, rng.choice([7, 8]), f[2] + rng.choice(["", " nhà", " hoàng"])) for i, f in enumerate(fixes) if f[2]]
    data = [spark.createDataFrame(rows, f"{key} BIGINT, user_id BIGINT, text STRING") for rows, key in ((log, "row_id"), (fixes, "correction_id"))]
    weights = similarity.gram_weights(spark.createDataFrame([(t,) for t in corpus], "text STRING"), F.col("text"))
    got = {r.row_id: (r.correction_id, r.match_type, round(r.score, 7)) for r in similarity.similar_corrections(*data, weights, 0.8).collect()}

    plain = plain_words(spark, {t for _, _, t in log + fixes if t} | set(corpus))
    df = {}
    for t in corpus:
        for g in set(plain_grams(plain[t])):
            df[g] = df.get(g, 0) + 1

    def vector(text):
        grams = plain_grams(plain.get(text, []))
        v = {g: grams.count(g) * (math.log((1 + len(corpus)) / (1 + df.get(g, 0))) + 1) for g in set(grams)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / norm for g, x in v.items()}

    want = {}
    for row, user, text in log:
        mine = [(c, t) for c, u, t in fixes if u == user and t and t.strip()]
        same = [c for c, t in mine if text and " ".join(plain[text]) == t.strip().lower()]
        if same:
            want[row] = (min(same), "exact", 1.0)
            continue
        a = vector(text)
        best = max(((round(sum(a.get(g, 0) * x for g, x in vector(t).items()), 9), -c) for c, t in mine), default=(0, 0))
        if best[0] >= 0.8:
            want[row] = (-best[1], "similarity", round(best[0], 7))
    assert got == want and 10 not in got and {k for _, k, _ in want.values()} == {"exact", "similarity"}


def test_shorten_keeps_what_and_how_much(spark):
    long = "mua cà phê sữa đá ở food court trung tâm thương mại tổng 45k, thanh toán bằng quẹt thẻ"
    df = spark.createDataFrame([(long, "Food", "expense"), ("mua gạo 20k", "Food", "expense"),
                                ("Nay có khoản về từ bán đồ cũ online, 500k chuyển khoản cái rẹt", "Business", "income")], "t STRING, l STRING, k STRING")
    got = [r["x"] for r in df.select(curate.shorten(F.col("t"), F.col("l"), F.col("k")).alias("x")).collect()]
    assert got == ["mua cà phê sữa đá 45k", "mua gạo 20k", "bán đồ cũ online 500k"]


def test_several_comparisons_of_one_user(spark):
    spent = spark.createDataFrame([(7, "expense", "2024-05-03 10:00:00", 100), (7, "expense", "2024-04-03 10:00:00", 40)],
                                  "user_id LONG, type STRING, ts STRING, amount LONG").withColumn("ts", F.to_timestamp("ts"))
    slots = spark.createDataFrame([(i, 7, "tháng này vs tháng trước", "2024-05-20 00:00:00") for i in (1, 2)],
                                  "request_id LONG, user_id LONG, slot STRING, anchor STRING").withColumn("anchor", F.to_timestamp("anchor"))
    got = ledger.compare_periods(spent, slots).orderBy("request_id").collect()
    assert [(r.request_id, r.first, r.second) for r in got] == [(1, 100, 40), (2, 100, 40)]


def test_feedback_touches_the_first_table_only(spark):
    corpus = spark.createDataFrame([(1, "Mua gạo", "Record", None), (2, "mua gạo ", "Action", None)],
                                   "row_id LONG, text STRING, intent STRING, category_code STRING")
    log = spark.createDataFrame([(1, "mua gạo", "dislike", '{"intent_disliked": true, "corrected_intent": "Record", "corrected_category": "cat_food"}')],
                                "row_id LONG, text_input STRING, log_type STRING, payload STRING")
    got = sorted((r.row_id, r.intent, r.category_code, r.op) for r in dedupe.merge_feedback(corpus, log).collect())
    assert got == [(1, "Record", "cat_food", "update"), (2, "Action", None, "keep")]


def test_plain_amounts(spark):
    rows = spark.createDataFrame([("1,234.567", None), ("1.234,567", 1234567), ("12.000", 12000), ("1,000,000", 1000000), ("0", None)], "t STRING, v LONG")
    assert all(r.v == r.got for r in rows.withColumn("got", money.parse_plain_amount(F.col("t"))).collect())


def test_cap_holds_at_every_size(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("label"))
    for cap in (1000, 2999, 200_000):
        assert sample.subsample_by_label(rows, "label", cap).count() == min(cap, 3000)


def test_rank_of_hashed_ids(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("row_id"), (F.col("id") % 2).alias("k"))
    got = ordering.rank_by_id(rows, "k").collect()
    for k in (0, 1):
        mine = sorted((r.row_id, r["rank"]) for r in got if r.k == k)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_crowded_group_splits(spark):
    boxes = spark.range(30_000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 1500 + 1500).alias("y1"), "id")
    assert scan._banded(boxes, ["y1", "id"], 32).select("_band").distinct().count() == 32
    for width in (None, 32):
        rows = scan.running_sum(boxes, "g", ["y1", "id"], F.lit(1), "n", width).collect()
        assert [r.n for r in sorted(rows, key=lambda r: (r.y1, r.id))] == list(range(1, 30_001))
