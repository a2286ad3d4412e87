from pathlib import Path

from pyspark.sql import functions as F

from tallyspark.operators.dedupe import append_new, merge_feedback
from tallyspark.streaming import jobs
from tallyspark.streaming.buckets import BucketStore

LOG = "row_id LONG, text_input STRING, log_type STRING, payload STRING"
CORPUS = "row_id LONG, text STRING, intent STRING, category_code STRING"


def log_rows(k):
    fix = lambda intent: f'{{"intent_disliked": true, "corrected_intent": "{intent}"}}'
    return [(10 * k + 1, "mua gạo", "dislike", fix(["Record", "Action", "Chitchat"][k])), (10 * k + 2, f"new {k}", "dislike", fix("Action")),
            (10 * k + 3, f"new {k - 1}", "dislike", fix("Chitchat"))]


def stream_of(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_jobs_resume(spark, tmp_path):
    """Three files, one per batch; the jobs stop after two and go on with the third, and equal one batch over all."""
    logs, corpus = str(tmp_path / "logs"), spark.createDataFrame([(1, "mua gạo", "Chitchat", "x"), (2, "xăng", "Record", None)], CORPUS)
    every = [r for k in range(3) for r in log_rows(k)]
    for k in range(3):
        spark.createDataFrame(log_rows(k), LOG).coalesce(1).write.mode("append").parquet(logs)
        if k == 0:
            continue
        fixed = jobs.apply_corrections(corpus, stream_of(spark, logs), CORPUS, str(tmp_path / "fixed"))
        texts = stream_of(spark, logs).select("row_id", F.col("text_input").alias("text"))
        sink = jobs.append_stream(texts, "row_id LONG, text STRING", str(tmp_path / "sink"))
    key = lambda df: sorted((r.text, r.intent) for r in df.collect())
    assert key(fixed) == key(merge_feedback(corpus, spark.createDataFrame(every, LOG)))
    whole = append_new(spark.createDataFrame([], "row_id LONG, text STRING"), spark.createDataFrame(every, LOG).select("row_id", F.col("text_input").alias("text")))
    assert sorted(r.text for r in sink.collect()) == sorted(r.text for r in whole.collect())


def test_append_without_batches(spark, tmp_path):
    spark.createDataFrame([], LOG).write.parquet(str(tmp_path / "none"))
    texts = stream_of(spark, str(tmp_path / "none")).select("row_id", F.col("text_input").alias("text"))
    assert jobs.append_stream(texts, "row_id LONG, text STRING").count() == 0


def listing(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def keyed_rows(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k STRING, v LONG")


def test_bucket_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), "k STRING, v LONG", F.col("k"), F.col("v"), limit=40)
    store.create(keyed_rows(spark, [f"k{i}" for i in range(300)] + [None] * 100))
    assert len(store.manifest(0)) == 16 and store.rows(0).count() == 400
    before = listing(tmp_path / "data")
    change = keyed_rows(spark, ["k7", "new"])
    places = store.touched(0, change, F.col("k"))
    merge = lambda rows: rows.filter("k IS NULL OR k <> 'k7'").union(change)
    store.update(0, places, merge)
    entries = store.manifest(1)
    assert 1 <= len(places) <= 2
    assert sum(v == 1 for v, _ in entries.values()) == len({b for b in entries if any(b.startswith(p) for p in places) and entries[b][0] is not None})
    assert {p: t for p, t in listing(tmp_path / "data").items() if p in before} == before
    assert {r.k: r.v for r in store.rows(1).filter("k IN ('k7', 'new')").collect()} == {"k7": 0, "new": 1} and store.rows(1).count() == 401
    after = listing(tmp_path)
    store.update(0, places, lambda rows: rows.limit(0))  # a repeated batch changes nothing
    assert listing(tmp_path) == after and store.latest() == 1


def test_bucket_store_splits_what_has_grown(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), "k STRING, v LONG", F.col("k"), limit=20)
    store.create(spark.createDataFrame([], "k STRING, v LONG"))
    for n in range(4):
        new = keyed_rows(spark, [f"{n}-{i}" for i in range(60)])
        store.update(n, store.touched(n, new, F.col("k")), lambda rows, new=new: rows.union(new))
    entries = store.manifest(4)
    assert sum(rows for _, rows in entries.values()) == 240 and len(entries) >= 6
    assert not any(a != b and b.startswith(a) for a in entries for b in entries)
    one = store.touched(4, keyed_rows(spark, ["2-17"]), F.col("k"))
    assert len(one) == 1 and [r.k for r in store.rows(4, one).filter("k = '2-17'").collect()] == ["2-17"]


def test_bytes_read_do_not_grow_with_the_batches(spark, tmp_path):
    """Five batches of equal size; the files that a batch of two keys must read stay as large as after the first."""
    store = BucketStore(spark, str(tmp_path), "k STRING, v LONG", F.col("k"), limit=100)
    store.create(spark.createDataFrame([], "k STRING, v LONG"))
    rows_read = []
    for n in range(5):
        new = keyed_rows(spark, [f"{n}-{i}" for i in range(400)])
        store.update(n, store.touched(n, new, F.col("k")), lambda rows, new=new: rows.union(new))
        asked = store.touched(n + 1, keyed_rows(spark, ["0-1", "0-2"]), F.col("k"))
        rows_read.append(store.rows(n + 1, asked).count())
    assert max(rows_read[1:]) <= 2 * 400 and rows_read[-1] <= rows_read[0] + 400 and store.rows(5).count() == 2000


def test_streams_touch_few_buckets(spark, tmp_path):
    """Three batches of corrections over many small buckets: files of untouched buckets stay, results equal the batch form."""
    logs, path = str(tmp_path / "logs"), str(tmp_path / "fixed")
    corpus = spark.createDataFrame([(i, f"note {i}", "Chitchat", "x") for i in range(200)] + [(900, "mua gạo", "Chitchat", "x"), (901, None, "Record", None)], CORPUS)
    for k in range(3):
        spark.createDataFrame(log_rows(k), LOG).coalesce(1).write.mode("append").parquet(logs)
    fixed = jobs.apply_corrections(corpus, stream_of(spark, logs), CORPUS, path, limit=10)
    every = spark.createDataFrame([r for k in range(3) for r in log_rows(k)], LOG)
    key = lambda df: sorted((r.row_id or -1, r.text or "", r.intent) for r in df.collect())
    assert key(fixed) == key(merge_feedback(corpus, every).drop("op"))
    store = BucketStore(spark, f"{path}/corpus", CORPUS, F.col("text"))
    versions = [v for v, _ in store.manifest(3).values()]
    assert len(versions) >= 32 and versions.count(0) >= len(versions) - 8
