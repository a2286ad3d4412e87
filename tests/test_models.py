import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tallyspark.operators import calibrated, slots, understand

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def vectors(seed, n, classes=4, dim=8, spread=1.3):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).standard_normal((classes, dim))
    share = np.array([0.6, 0.25, 0.1, 0.05])[:classes]
    y = rng.choice(classes, n, p=share / share.sum())
    x = centers[y] + rng.standard_normal((n, dim)) * spread
    return [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]


def calibration_error(rows, bins=10):
    """Mean gap between confidence and hit rate over bins of confidence."""
    c = np.array([r.confidence for r in rows])
    hit = np.array([r.label == r.label_pred for r in rows], dtype=float)
    place = np.minimum((c * bins).astype(int), bins - 1)
    return sum(abs(c[place == b].mean() - hit[place == b].mean()) * (place == b).mean() for b in set(place.tolist()))


def raw_scores(model, rows):
    """What one balanced classifier says without its sigmoids."""
    scored = model.transform(rows.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>"))))
    return scored.select(vector_to_array("_q").alias("probability"))


def test_confidence_of_new_rows_is_calibrated(spark, tmp_path):
    model = calibrated.fit_calibrated(spark.createDataFrame(vectors(1, 3000) + [(9999, None, 1), (9998, [0.0] * 8, None)], VECTORS), "vec_id", "label")
    fresh = spark.createDataFrame(vectors(2, 3000), VECTORS)
    rows = model.score(fresh).collect()
    assert calibration_error(rows) <= 0.08
    shares = np.mean([[r.distribution[k] for k in range(4)] for r in rows], axis=0)
    plain = np.mean([list(r.probability) for r in raw_scores(model.models[0], fresh).collect()], axis=0)
    true = np.mean([[r.label == k for k in range(4)] for r in rows], axis=0)
    assert np.abs(shares - true).max() <= 0.03 < np.abs(plain - true).max()  # balanced weights alone overrate rare classes
    assert np.mean([r.label == r.label_pred for r in rows]) >= 0.65
    assert all(math.isclose(sum(r.distribution.values()), 1, abs_tol=1e-9) and math.isclose(max(r.distribution.values()), r.confidence) for r in rows[:50])
    model.save(spark, str(tmp_path))
    again = calibrated.CalibratedModel.load(spark, str(tmp_path), int)
    assert again.labels == [0, 1, 2, 3]
    assert again.score(fresh.limit(20)).select("label_pred", "confidence").collect() == model.score(fresh.limit(20)).select("label_pred", "confidence").collect()


def test_sigmoids_against_plain_newton(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    margins = rng.standard_normal((400, 3)) * 2 + 2.5 * np.eye(3)[y]
    fold = rng.integers(0, 2, 400)
    rows = [(int(f), int(k), m.tolist()) for f, k, m in zip(fold, y, margins, strict=True)]
    got = calibrated.fit_sigmoids(spark.createDataFrame(rows, "fold INT, y INT, margin ARRAY<DOUBLE>"), 3, 2)
    for f in range(2):
        for k in range(3):
            m, hit = margins[fold == f, k], y[fold == f] == k
            t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
            at, design = np.zeros(2), np.column_stack([m, np.ones(len(m))])
            for _ in range(50):
                p = 1 / (1 + np.exp(-design @ at))
                at += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (t - p))
            assert np.allclose(got[f][k], at, atol=1e-4)


def test_class_missing_from_a_fold(spark):
    rows = vectors(5, 300, classes=3)
    rare = next(i for i in range(1000, 2000))
    data = spark.createDataFrame(rows + [(rare, [9.0] * 8, 3)], VECTORS)
    scored = calibrated.fit_calibrated(data, "vec_id", "label").score(data).filter(F.col("label") < 3).collect()
    assert len(scored) == 300 and all(0 < r.confidence <= 1 for r in scored)


SLOTS = "row_id LONG, text STRING, action_type STRING, verb STRING, category_code STRING, value STRING, goal_name STRING, enabled STRING, theme STRING, verbal_style STRING, time_range STRING, query STRING"


def slot_row(i, text, action, **filled):
    names = [c.split()[0] for c in SLOTS.split(", ")]
    return tuple({"row_id": i, "text": text, "action_type": action, **filled}.get(n) for n in names)


def slot_rows(seed, n):
    """Limits, reports, goals and tones; ``xanh`` means a different category for a limit than for a report."""
    rng = np.random.default_rng(seed)
    foods, rides = ["phở", "bún", "cơm"], ["xe buýt", "taxi", "xăng"]
    rows = []
    for i in range(n):
        kind, tail = i % 5, f"số {rng.integers(0, 10_000)}"
        food = rng.choice(foods)
        if kind == 0:
            amount = int(rng.choice([100, 2000]))
            size = "nhỏ" if amount == 100 else "lớn"
            rows.append(slot_row(i, f"đặt hạn mức {rng.choice([food, 'xanh'])} {size} {tail}", "SET_LIMIT", verb="SET", category_code="Food", value=f"{amount}.0"))
        elif kind == 1:
            rows.append(slot_row(i, f"tăng hạn mức {rng.choice(rides)} lớn {tail}", "SET_LIMIT", verb="ADD", category_code="Transport", value="2000"))
        elif kind == 2:
            when = rng.choice(["tháng này", "tuần trước"])
            rows.append(slot_row(i, f"báo cáo {rng.choice([*rides, 'xanh'])} {when} {tail}", "Report_General", category_code="Transport", time_range=when))
        elif kind == 3:
            rows.append(slot_row(i, f"góp vào quỹ mua nhà lớn {tail}" if i % 2 else f"góp vào quỹ du lịch lớn {tail}", "ADD_GOAL", verb="ADD",
                                 goal_name="mua nhà" if i % 2 else "du lịch", value="2000"))
        else:
            tone = rng.choice(["funny", "strict"])
            rows.append(slot_row(i, f"nói {'vui' if tone == 'funny' else 'nghiêm'} vào {tail}", "SET_TONE", verbal_style=tone, category_code="nan"))
    return rows


def test_slots_depend_on_the_action(spark):
    model = slots.fit_slots(spark.createDataFrame(slot_rows(1, 500), SLOTS))
    asked = [(1, "đặt hạn mức phở 50k", "SET_LIMIT", "50k"), (2, "xanh", "SET_LIMIT", None), (3, "xanh tuần trước", "report_general", ""),
             (4, "góp vào quỹ du lịch lớn", "ADD_GOAL", None), (5, "nói vui thôi, phở tuần trước", "SET_TONE", None), (6, "đổi giao diện", "SETTING", None),
             (7, "xóa khoản phở", "DELETE", None), (8, None, None, None), (9, slot_rows(1, 500)[0][1], "SET_LIMIT", None), (10, "đặt hạn mức phở lớn", "SET_LIMIT", "không có số")]
    data = spark.createDataFrame(asked, "row_id LONG, text STRING, action_type STRING, amount_span STRING")
    got = {r.row_id: r for r in slots.predict_slots(data, model).collect()}
    filled = {i: {d: r[d] for d in slots.DETAILS if r[d] is not None} for i, r in got.items()}
    assert len(got) == 10
    assert (filled[1]["value"], filled[1]["unit"], filled[1]["target"], filled[1]["target_type"], filled[1]["verb"]) == ("50000", "VND", "Food", "LIMIT", "SET")
    assert filled[2]["target"] == "Food" and got[3].target == "Transport" and got[3].time == ["tuần trước"] and got[3].value is None
    assert {k: filled[4][k] for k in ("goal_name", "target", "target_type", "verb")} == {"goal_name": "du lịch", "target": "du lịch", "target_type": "GOAL", "verb": "ADD"}
    assert filled[5] == {"verbal_style": "funny"} and filled[6].keys() <= {"theme"} and filled[7] == {} and filled[8] == {}
    assert filled[9]["value"] == slot_rows(1, 500)[0][5] and got[6].action == "SYSTEM_SETTING"
    assert math.sqrt(100 * 2000) < int(filled[10]["value"]) < 4000  # nearer to 2000 than to 100 on the log scale


def test_slots_of_rows_outside_the_fit(spark):
    model = slots.fit_slots(spark.createDataFrame(slot_rows(1, 500), SLOTS))
    fresh = slot_rows(2, 200)
    data = spark.createDataFrame([(r[0], r[1], r[2], None) for r in fresh], "row_id LONG, text STRING, action_type STRING, amount_span STRING")
    got = {r.row_id: r for r in slots.predict_slots(data, model).collect()}
    checks = [(got[r[0]].verb, r[3]) for r in fresh if r[3]] + [(got[r[0]].target, r[4] or r[7]) for r in fresh if r[4] not in (None, "nan") or r[7]]
    checks += [((got[r[0]].time or [None])[0], r[10]) for r in fresh] + [(got[r[0]].verbal_style, r[9]) for r in fresh]
    assert np.mean([a == b for a, b in checks]) >= 0.97
    ratio = [math.log(int(got[r[0]].value) / float(r[5])) for r in fresh if r[5]]
    assert np.mean(np.abs(ratio)) < 0.5


def test_slots_without_training_rows(spark):
    model = slots.fit_slots(spark.createDataFrame([], SLOTS))
    data = spark.createDataFrame([(1, "đặt hạn mức 50k", "SET_LIMIT", "50k"), (2, "đặt hạn mức", "SET_LIMIT", None)], "row_id LONG, text STRING, action_type STRING, amount_span STRING")
    got = {r.row_id: r.value for r in slots.predict_slots(data, model).collect()}
    assert got == {1: "50000", 2: None}


SAID = "row_id LONG, text STRING, item STRING, intent_pred STRING, intent_prob DOUBLE, record_type_pred STRING, category_pred STRING, category_item STRING, action_type_pred STRING, match_type STRING, match_score DOUBLE, match_intent STRING, match_category STRING, match_record_type STRING"


def test_corrections_go_before_models(spark):
    rows = [(1, "mua gạo 50k", "gạo", "Record", 0.9, "expense", "Food", "Essentials", None, None, None, None, None, None),
            (2, "lương về 5tr", "lương", "Record", 0.8, "income", "Salary", "SALARY", None, None, None, None, None, None),
            (3, "gạo 20k", "gạo", "Chitchat", 0.7, "expense", "Food", None, None, "similarity", 0.9, "log", "Business", "thu"),
            (4, "đặt hạn mức 500k", None, "Action", 0.6, "expense", "Food", None, "SET_LIMIT", None, None, None, None, None),
            (5, "chào", None, "Record", 0.6, None, None, None, None, "exact", 1.0, "chat", None, None),
            (6, None, None, "Record", 0.5, None, None, "Food", None, "exact", 1.0, "", "", "")]
    got = {r.row_id: r for r in understand.decided(spark.createDataFrame(rows, SAID)).collect()}
    assert (got[1].category, got[1].category_agreement, got[1].amount_spent, got[1].record_type, got[1].income_type) == ("Food", False, 50_000, "Expense", None)
    assert (got[2].category, got[2].category_agreement, got[2].income_type, got[2].amount_spent) == ("SALARY", True, "salary", 5_000_000)
    assert (got[3].intent, got[3].intent_backend, got[3].intent_confidence, got[3].category, got[3].category_backend, got[3].record_type, got[3].income_type) == (
        "Record", "user_similarity", 0.9, "Business", "user_similarity", "Income", "business")
    assert (got[4].action_type, got[4].action_param, got[4].category, got[4].amount_spent) == ("SET_LIMIT", 500_000, None, None)
    assert (got[5].intent, got[5].intent_backend, got[5].category) == ("Chitchat", "user_exact", None)
    assert (got[6].intent, got[6].intent_backend, got[6].category, got[6].category_agreement, got[6].record_type) == ("Record", "tfidf", "Food", True, None)
