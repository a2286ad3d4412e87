"""Work on the rows of a small file is dealt over tasks."""

from pyspark.sql import functions as F

from tallyspark.operators import generate, ml, ordering, slots


def test_a_file_of_one_part_is_dealt(spark):
    rows = ordering.dealt(spark.range(0, 1000, 1, 1), "id", rows=100)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.count() == 1000 and len(sizes) == 10
    assert ordering.dealt(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert ordering.dealt(spark.range(0), "id").count() == 0


def test_short_records_are_made_in_many_tasks(spark, monkeypatch):
    topics = spark.range(0, 400, 1, 1).selectExpr("id AS row_id", "'gạo' AS topic")
    monkeypatch.setattr(generate, "dedupe_exact", lambda df: df)
    made = generate.short_records(topics)
    parts = made.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) > 5  # one of each of the five branches
    assert made.filter("text IS NULL OR text = ''").count() == 0


def test_rows_are_repeated_as_often_as_they_say(spark):
    rows = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "x STRING, n BIGINT")
    got = ordering.repeated(rows, "n", chunk=10).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in got} == {"a": 25, "b": 1, "c": 10}


def test_slots_make_grams_once_per_different_row(spark, monkeypatch):
    made = [("đặt hạn mức food 100k", "SET_LIMIT", "SET", "Food", "100000"), ("mục tiêu mua nhà 200k", "SET_GOAL", "mul", "Home", "200000")]
    train = spark.createDataFrame([(i, *made[i % 2], "100k") for i in range(60)], "row_id BIGINT, text STRING, action_type STRING, verb STRING, category_code STRING, value STRING, amount_span STRING")
    seen, blocks = [], slots._blocks
    monkeypatch.setattr(slots, "_blocks", lambda rows: (seen.append(rows.count()), blocks(rows))[1])
    model = slots.fit_slots(train, iterations=2)
    got = slots.predict_slots(train, model).collect()
    assert len(seen) >= 3 and max(seen) <= 10
    assert sorted(r.row_id for r in got) == list(range(60)) and {r.value for r in got} == {"100000"}


def test_classifier_makes_grams_once_per_different_text(spark, monkeypatch):
    rows = spark.createDataFrame([(("mua gạo", "Food"), ("đi grab", "Transport"))[i % 2] for i in range(60)], "text STRING, label STRING")
    seen, grams = [], ml.with_grams
    monkeypatch.setattr(ml, "with_grams", lambda df, text: (seen.append(df.count()), grams(df, text))[1])
    model = ml.fit_text_classifier(rows, F.col("text"), "label", 100, iterations=5)
    assert seen == [2]
    assert ml.predict(model, rows, F.col("text")).filter("label_pred <> label").count() == 0
