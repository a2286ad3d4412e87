"""Queries over sources, sinks, streams and models: S1-S15, S17, ST1-ST9, M1-M6, M9."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import rules, schemas
from tallyspark.functions import text as tx
from tallyspark.operators import calibrated, evaluate, ml, sample, similarity, slots, understand
from tallyspark.operators.ordering import keep_first
from tallyspark.plans import duck
from tallyspark.plans import receipts as rq
from tallyspark.plans.functions import amounts_sql
from tallyspark.plans.metrics import AVERAGES, HIER, class_sql
from tallyspark.plans.registry import ORACLE, query
from tallyspark.session import scratch
from tallyspark.sources import io
from tallyspark.streaming import jobs

U4 = ["text", "label", "type", "is_money"]
#: Row ids whose rows may share a JSON array.
ARRAY_IDS = 160_000


# --- files -----------------------------------------------------------------------------------------
@query("s1_read_labelled", "SELECT text, label, is_money FROM @U u")
def _(t):
    path = scratch(t.spark, "csv")
    io.write_csv(t.U.select(*U4), path)
    return io.read_labelled(t.spark, path, schemas.RECORDS, ["text", "label", "is_money"])


@query("s2_read_headerless", "SELECT text, label, type, is_money FROM @U u")
def _(t):
    path = scratch(t.spark, "csv")
    io.write_csv(t.U.select(*U4), path, header=False)
    return io.read_headerless(t.spark, path, U4, {"is_money": "int"})


@query("s3_read_jsonl", "SELECT text, label, type, is_money FROM @U u")
def _(t):
    path = scratch(t.spark, "jsonl")
    io.write_jsonl(t.U.select(*U4), path)
    return io.read_jsonl(t.spark, path, schemas.RECORDS)


@query("s4_read_json_array", "SELECT row_id % 16 AS part, row_id, text, label FROM @U u")
def _(t):
    """Array files of bounded length below one folder per hash bucket, read back."""
    path = scratch(t.spark, "json-array")
    entries = F.to_json(F.collect_list(F.struct("row_id", "text", "label")))
    block = F.floor(F.col("row_id") / ARRAY_IDS)
    arrays = t.U.groupBy((F.col("row_id") % 16).alias("part"), block.alias("block")).agg(entries.alias("value"))
    arrays.drop("block").write.option("maxRecordsPerFile", 1).partitionBy("part").text(path)
    return io.read_json_array(t.spark, path, "row_id LONG, text STRING, label STRING, part LONG").select("part", "row_id", "text", "label")


@query("s5_logs_of_type", "SELECT row_id, text_input, payload FROM @F f WHERE log_type = 'dislike'")
def _(t):
    return io.logs_of_type(t.F, "dislike").select("row_id", "text_input", "payload")


POLY = """concat('[', array_join(transform(p, b -> concat('{''bbox'': [', b.x1, ', ', b.y1, ', ', b.x2 - b.x1, ', ', b.y2 - b.y1, '], ''width'': 800, ''height'': 1000, ''area'': None}')), ', '), ']')"""


@query("s6_read_annotations", """SELECT concat('img_', receipt_id, '.jpg') AS img_id, count(*) AS polygons, CAST(sum(x2 - x1) AS BIGINT) AS widths,
string_agg(text, '~' ORDER BY box_id) AS texts, string_agg(CASE WHEN box_id = 0 THEN 'SELLER' ELSE 'O' END, '~' ORDER BY box_id) AS labels FROM @R r GROUP BY receipt_id""")
def _(t):
    path = scratch(t.spark, "annotations")
    rows = t.R.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2", "text"))).alias("p"))
    packed = rows.selectExpr("concat('img_', receipt_id, '.jpg') AS img_id", f"{POLY} AS anno_polygons",
                             "array_join(transform(p, b -> b.text), '|||') AS anno_texts",
                             "array_join(transform(p, b -> CASE WHEN b.box_id = 0 THEN 'SELLER' ELSE 'O' END), '|||') AS anno_labels")
    io.write_csv(packed, path)
    got = io.read_annotations(t.spark, path)
    widths = F.aggregate(F.transform("polygons", lambda p: p["bbox"][2].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return got.select("img_id", F.size("polygons").alias("polygons"), widths.alias("widths"), F.array_join("texts", "~").alias("texts"), F.array_join("labels", "~").alias("labels"))


@query("s7_read_transcripts", """SELECT CAST(receipt_id % 32 AS VARCHAR) AS sample_id, CAST(box_id AS INT) AS idx, x1 AS x0, y1 AS y0, x2, y2, text, CASE WHEN box_id = 0 THEN 'SELLER' ELSE 'OTHER' END AS label FROM @R r""")
def _(t):
    path = scratch(t.spark, "transcripts")
    boxes = t.R.select((F.col("receipt_id") % 32).alias("sample_id"), F.col("box_id").alias("box_no"), "x1", "y1", "x2", "y2", "text",
                       F.when(F.col("box_id") == 0, "seller").alias("admin_label"), F.lit("O").alias("auto_label"))
    io.transcript_rows(boxes).write.partitionBy("sample_id").options(sep="\t", quote='"', escape='"').csv(path)
    return io.read_transcripts(t.spark, path)


@query("s8_parse_training_log", """SELECT doc_id, unnest([10, 20]) AS step, unnest([doc_id % 50 / 10.0, doc_id % 50 / 10.0 + 1]) AS epoch, unnest([doc_id % 900 / 100.0, 1.5]) AS loss, unnest([0.5, 0.25]) AS learning_rate FROM documents""")
def _(t):
    point = lambda loss, lr, epoch: F.format_string("{'loss': %s, 'grad_norm': 0.5, 'learning_rate': %s, 'epoch': %s}", loss, lr, epoch)
    n = F.col("doc_id")
    one, two = F.format_string("%.2f", n % 900 / 100), F.format_string("%.1f", n % 50 / 10)
    log = F.concat("text", point(one, F.lit("0.5"), two), F.lit(" x "), point(F.lit("1.5"), F.lit("0.25"), F.format_string("%.1f", n % 50 / 10 + 1)), "text")
    return io.parse_training_log(t.documents.select("doc_id", log.alias("text")))


@query("s9_write_csv", "SELECT text, label, type FROM @U u")
def _(t):
    path = scratch(t.spark, "csv")
    io.write_csv(t.U.select(*U4), path)
    return io.read_labelled(t.spark, path, schemas.RECORDS, ["text", "label", "type"])


@query("s10_write_jsonl", "SELECT text, sentiment FROM (SELECT text, role AS sentiment FROM conversations) c")
def _(t):
    path = scratch(t.spark, "jsonl")
    io.write_jsonl(t.conversations.select("text", F.lit("Chitchat").alias("intent"), F.col("role").alias("sentiment")), path)
    return io.read_jsonl(t.spark, path, schemas.CHITCHAT).select("text", "sentiment")


@query("s11_transcript_rows", """SELECT receipt_id AS sample_id, box_id AS idx, x1 AS x0, y1 AS y0, x2 AS x1, y1, x2, y2, x1 AS x3, y2 AS y3, text,
CASE WHEN box_id = 0 THEN 'SELLER' ELSE 'OTHER' END AS label FROM @R r""")
def _(t):
    boxes = t.R.select(F.col("receipt_id").alias("sample_id"), F.col("box_id").alias("box_no"), "x1", "y1", "x2", "y2", "text",
                       F.when(F.col("box_id") == 0, "seller").alias("admin_label"), F.lit("o").alias("auto_label"))
    return io.transcript_rows(boxes)


@query("s12_quad_lines", """SELECT receipt_id AS image, box_id AS box_no, concat_ws(',', x1, y1, x2, y2, 0, 0, 0, 0, text, CASE WHEN box_id = 0 THEN 'SELLER' ELSE 'OTHER' END) AS line FROM @R r""")
def _(t):
    boxes = t.R.select(F.col("receipt_id").alias("image"), F.col("box_id").alias("box_no"), F.array("x1", "y1", "x2", "y2").alias("coords"), "text",
                       F.when(F.col("box_id") == 0, "seller").alias("entity"))
    return io.quad_lines(boxes)


@query("s13_write_metrics", f"WITH {HIER}, c AS ({class_sql('x', 'task')}) SELECT task, {AVERAGES} FROM c GROUP BY task")
def _(t):
    path = scratch(t.spark, "metrics")
    pairs = evaluate.hierarchical_pairs(t.P)
    low = pairs.withColumn("label_true", F.lower("label_true")).withColumn("label_pred", F.lower("label_pred"))
    rows = evaluate.averages(low, ["task"])
    io.write_metrics(rows.withColumn("accuracy", F.lit(0.0)), path)
    io.write_metrics(rows.filter("task IN ('intent', 'category')"), path)
    io.write_metrics(rows.filter("task NOT IN ('intent', 'category')"), path)
    return t.spark.read.parquet(path)


@query("s14_append_fresh", """SELECT row_id, text_input AS text FROM (SELECT *, row_id % 2 AS half FROM @F f) x
QUALIFY row_number() OVER (PARTITION BY trim(text_input) ORDER BY half, row_id) = 1""")
def _(t):
    path = scratch(t.spark, "sink")
    rows = t.F.select("row_id", F.col("text_input").alias("text"))
    for half in (0, 1):
        io.append_fresh(t.spark, path, rows.filter(F.col("row_id") % 2 == half), "row_id BIGINT, text STRING")
    return t.spark.read.parquet(path)


@query("s15_manifest", """SELECT concat('images/img_', receipt_id, '.jpg') AS image, receipt_id AS sample_id, 'train' AS split FROM @R r WHERE box_id = 0 AND receipt_id % 10 <> 0""")
def _(t):
    samples = t.R.filter("box_id = 0").select(F.col("receipt_id").alias("sample_id"), F.concat(F.lit("img_"), "receipt_id", F.lit(".jpg")).alias("image"))
    return io.manifest(samples, rq._images(t))


@query("s17_tag_lines", f"WITH {rq.R}, {rq.WORDS} SELECT receipt_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM words GROUP BY 1")
def _(t):
    return io.tag_lines(rq._words(t))


# --- streams ---------------------------------------------------------------------------------------
def _log(t):
    return jobs.interactions(t.spark, t.sf_dir)


def _spend(t):
    return _log(t).withColumn("amount", F.col("latency_ms")).withColumn("category", F.coalesce("category", F.lit("none")))


@query("st1_intake", "SELECT DISTINCT lower(trim(text_input)) AS text_key FROM @F f WHERE log_type = 'dislike'")
def _(t):
    return jobs.run_append(jobs.intake(_log(t)), "intake")


@query("st2_apply_corrections", ORACLE["j4_merge_feedback"].replace("category_code, op FROM h", "category_code FROM h").replace(
    "coalesce(nc, ''), 'insert' FROM g", "coalesce(nc, '') FROM g"))
def _(t):
    corpus = t.A.selectExpr(
        "row_id", "concat('mua gạo ', row_id % 200, 'k') AS text",
        "CASE row_id % 3 WHEN 0 THEN 'Record' WHEN 1 THEN 'Action' ELSE 'Chitchat' END AS intent",
        "CASE WHEN row_id % 4 = 0 THEN 'cat_old' END AS category_code")
    return jobs.apply_corrections(corpus, _log(t).drop("at"), "row_id BIGINT, text STRING, intent STRING, category_code STRING")


@query("st3_append_stream", """SELECT row_id, text_input AS text FROM @F f QUALIFY row_number() OVER (PARTITION BY trim(text_input) ORDER BY row_id) = 1""")
def _(t):
    return jobs.append_stream(_log(t).select("row_id", F.col("text_input").alias("text")), "row_id BIGINT, text STRING")


@query("st4_label_counts", "SELECT intent, log_type, count(*) AS n FROM @F f GROUP BY 1, 2")
def _(t):
    return jobs.latest_counts(_log(t), ["intent", "log_type"])


def _closed(delay: str) -> str:
    return f"(SELECT max(ts) FROM events) - INTERVAL {delay}"


def _hours(df, *columns):
    """Window bounds as hours since the epoch, free of time zones."""
    return df.select(*columns, (F.unix_seconds("w.start") / 3600).cast("bigint").alias("start_hour"))


@query("st5_daily_spend", f"""SELECT user_id, CAST(sum(round_even(value * 100, 0)) AS BIGINT) AS cents, count(*) AS n, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) / 3600 AS BIGINT) AS start_hour
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts) HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {_closed('2 DAY')}""")
def _(t):
    return _hours(jobs.run_append(jobs.daily_spend(_utc(_spend(t))), "spend"), "user_id", "cents", "n")


def _utc(df):
    """Event time read as UTC, whatever the session's time zone."""
    return df.withColumn("at", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")))


@query("st6_frequent_categories", f"""WITH e AS (SELECT user_id, coalesce(category, 'none') AS category, time_bucket(INTERVAL 1 DAY, ts) - to_days(k) AS s
FROM @F f, (SELECT unnest(range(7)) AS k) z)
SELECT user_id, category, count(*) AS n, CAST(epoch(s) / 3600 AS BIGINT) AS start_hour FROM e GROUP BY user_id, category, s HAVING s + INTERVAL 7 DAY <= {_closed('2 DAY')} AND count(*) > 3""".replace("to_days(k)", "to_days(CAST(k AS INT))"))
def _(t):
    return _hours(jobs.run_append(jobs.frequent_categories(_utc(_spend(t))), "frequency"), "user_id", "category", "n")


@query("st7_rolling_quality", f"""SELECT log_type AS backend, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, round(avg(CASE WHEN row_id % 3 = 0 THEN 1.0 ELSE 0 END), 4) AS hit_rate,
CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) / 3600 AS BIGINT) AS start_hour FROM @F f GROUP BY log_type, time_bucket(INTERVAL 1 DAY, ts) HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {_closed('1 DAY')}""")
def _(t):
    log = _utc(_log(t)).select("at", F.col("log_type").alias("backend"), "latency_ms", (F.col("row_id") % 3 == 0).alias("hit"))
    rows = jobs.run_append(jobs.rolling_quality(log), "quality")
    return _hours(rows, "backend", "n", F.round("mean_ms", 4).alias("mean_ms"), F.round("hit_rate", 4).alias("hit_rate"))


@query("st8_chat_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS turns, CAST(floor(epoch(min(ts)) / 3600) AS BIGINT) AS start_hour FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {_closed('1 HOUR')}""")
def _(t):
    rows = jobs.run_append(jobs.chat_sessions(_utc(_log(t))), "sessions")
    return rows.select("user_id", "turns", F.floor(F.unix_seconds("w.start") / 3600).cast("bigint").alias("start_hour"))


@query("st9_budget_alerts", "SELECT user_id FROM events GROUP BY 1 HAVING sum(value) > 1500")
def _(t):
    return jobs.run_append(jobs.budget_alerts(_spend(t), 1500.0), "alerts")


# --- models ----------------------------------------------------------------------------------------
def _intents(t):
    act = t.A.select("text", F.lit("Action").alias("intent"))
    chat = t.conversations.select("text", F.lit("Chitchat").alias("intent"))
    return t.U.select("text", F.lit("Record").alias("intent")).unionByName(act).unionByName(chat)


def _category_rows(t):
    return t.U.filter("label IS NOT NULL").select("row_id", "text", "label")


GRAMS = """w AS (SELECT row_id, [x for x in string_split(trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-zA-Z_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if x <> ''] AS t FROM @U u),
g AS (SELECT row_id, unnest(list_concat(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]), [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)])) AS term FROM w)"""


@query("m1_ngram_idf", f"""WITH {GRAMS} SELECT term, count(*) AS tf, count(DISTINCT row_id) AS df, round(ln((1.0 + (SELECT count(*) FROM orders)) / (1.0 + count(DISTINCT row_id))) + 1.0, 6) AS idf
FROM g GROUP BY term ORDER BY tf DESC, term LIMIT 5000""")
def _(t):
    return ml.ngram_idf(t.U, "row_id", F.col("text"), 5000)


@query("m2_intent_classifier")
def _(t):
    model = ml.fit_text_classifier(_intents(t), F.col("text"), "intent", 5000)
    return ml.predict(model, _intents(t), F.col("text"), "intent_pred").select("intent", "intent_pred", "confidence")


@query("m3_category_svm")
def _(t):
    rows = sample.stratified_split(_category_rows(t), "label")
    model = ml.fit_text_classifier(rows.filter("split = 'train'"), tx.clean_category_text(F.col("text")), "label", 8000, linear_svm=True, iterations=5)
    return ml.predict(model, rows.filter("split = 'test'"), tx.clean_category_text(F.col("text"))).select("row_id", "label", "label_pred")


@query("m4_batch_predict")
def _(t):
    rows = _category_rows(t)
    model = ml.fit_text_classifier(rows, F.col("text"), "label", 2000, iterations=10)
    return ml.predict(model, rows, F.col("text")).select("row_id", "label_pred", "confidence")


@query("m5_embedding_classifier")
def _(t):
    rows = t.table("embeddings")
    train = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(5)) > 0
    model = calibrated.fit_calibrated(rows.filter(train), "vec_id", "label")
    scored = model.score(rows.select("vec_id", "label", "embedding"))
    return scored.select("vec_id", "label", "label_pred", F.round("confidence", 4).alias("confidence"), (~train).alias("held_out"))


def _slot_rows(t):
    canon = F.coalesce(tx.lookup(F.col("action_type"), rules.ACTION_ALIASES), F.col("action_type"))
    return t.A.withColumn("action_type", canon).withColumn("amount_span", F.regexp_extract(F.lower("text"), "[0-9]+k$", 0))


@query("m6_predict_slots")
def _(t):
    rows = _slot_rows(t)
    model = slots.fit_slots(rows.filter("row_id % 5 <> 0"))
    return slots.predict_slots(rows, model).withColumn("time", F.array_join("time", ",")).withColumn("held_out", F.col("row_id") % 5 == 0)


_ASKED = " UNION ALL ".join(f"SELECT '{a}' AS action, '{f}' AS field" for a, fields in rules.SLOTS_BY_ACTION.items() for f in fields)


@query("m6_exact_slots", f"""WITH a AS (SELECT row_id, text, CASE upper({duck.case_map('action_type', rules.ACTION_ALIASES, 'action_type')}) WHEN 'SETTING' THEN 'SYSTEM_SETTING'
ELSE upper({duck.case_map('action_type', rules.ACTION_ALIASES, 'action_type')}) END AS action, verb, category_code, value, goal_name, enabled, theme, verbal_style, time_range, query FROM @A a),
u AS ({" UNION ALL ".join(f"SELECT row_id, text, '{f}' AS field, {duck.blank(f)} AS value FROM a" for f in rules.SLOT_COLUMNS if f != "note")}),
e AS (SELECT field, text, value FROM u WHERE value IS NOT NULL AND (field <> 'value' OR TRY_CAST(value AS DOUBLE) IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY field, text ORDER BY row_id) = 1)
SELECT a.row_id, k.field, e.value FROM a JOIN ({_ASKED}) k ON k.action = a.action JOIN e ON e.field = k.field AND e.text = a.text""")
def _(t):
    rows = _slot_rows(t)
    cells = slots.labelled_slots(rows)
    known = slots.SlotModel(keep_first(cells, F.struct("field", "text"), "row_id").select("field", "text", "value"), {}, None, None)
    return slots.exact_slots(rows, known)


@query("m9_understand")
def _(t):
    spend = t.U.withColumns({"user_id": F.col("row_id") % 50, "item_spans": F.split("text", " "), "amount_span": F.lit(None).cast("string")})
    asked = t.A.select((-F.col("row_id")).alias("row_id"), "text", (F.col("row_id") % 50).alias("user_id"), F.lit(None).cast("array<string>").alias("item_spans"),
                       F.regexp_extract(F.lower("text"), "[0-9]+k$", 0).alias("amount_span"))
    rows = spend.select(*asked.columns).unionByName(asked).withColumn("ts", F.lit("1998-08-02 10:00:00"))
    fixes = t.U.filter("row_id % 40 = 0").select(
        F.col("row_id").alias("correction_id"), (F.col("row_id") % 50).alias("user_id"), similarity.normal_text(F.col("text")).alias("text"),
        F.expr("CASE row_id % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'system' END").alias("intent"), F.expr("CASE WHEN row_id % 80 = 0 THEN 'cat_food' END").alias("category_code"),
        F.expr("CASE WHEN row_id % 7 = 0 THEN 'thu' END").alias("record_type"))
    fit = lambda data, text, label: ml.fit_text_classifier(data, text, label, 2000, iterations=5)
    words = tx.clean_category_text(F.col("text"))
    models = understand.Models(
        fit(_intents(t), F.col("text"), "intent"), fit(t.U.filter("type IN ('expense', 'income')"), words, "type"), fit(_category_rows(t), words, "label"),
        fit(_slot_rows(t), F.col("text"), "action_type"), slots.fit_slots(_slot_rows(t), iterations=15), similarity.gram_weights(t.U, F.col("text")))
    found = understand.understand(rows, models, fixes)
    return found.select("row_id", "intent", "intent_confidence", "intent_backend", "clean_content", "amount_spent", "record_type", "record_type_backend", "income_type",
                        "item", "category", "category_backend", "category_ner", "category_agreement", "action_type", "action_param", "multi_record_task",
                        F.size("multi_records").alias("n_records"), F.col("action_details.target").alias("target"), F.col("action_details.value").alias("value"),
                        F.col("time_range.granularity").alias("granularity"))


M9_SAID = {
    "intent_pred": "CASE row_id % 5 WHEN 0 THEN 'Action' WHEN 1 THEN 'Chitchat' ELSE 'Record' END", "intent_prob": "0.5 + (row_id % 4) * 0.125",
    "record_type_pred": "CASE row_id % 7 WHEN 0 THEN 'income' WHEN 1 THEN 'Income' WHEN 2 THEN NULL ELSE 'expense' END",
    "category_pred": "CASE row_id % 6 WHEN 0 THEN 'Salary' WHEN 1 THEN NULL WHEN 2 THEN 'food' ELSE 'Food' END",
    "category_item": "CASE row_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Bonus' ELSE 'Food' END", "item": "CASE WHEN row_id % 4 > 0 THEN 'gạo' END",
    "action_type_pred": "CASE WHEN row_id % 2 = 0 THEN 'SET_LIMIT' END", "match_type": "CASE row_id % 9 WHEN 0 THEN 'exact' WHEN 1 THEN 'similarity' END",
    "match_score": "CASE row_id % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 0.875 END",
    "match_intent": "CASE WHEN row_id % 9 < 2 THEN CASE row_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'system' WHEN 2 THEN '' ELSE 'gì đó' END END",
    "match_category": "CASE WHEN row_id % 9 < 2 AND row_id % 5 < 3 THEN 'Business' END",
    "match_record_type": "CASE WHEN row_id % 9 < 2 THEN CASE row_id % 3 WHEN 0 THEN ' Thu' WHEN 1 THEN 'spending' END END",
}
_M9_CASTS = {"intent_prob": "DOUBLE", "match_score": "DOUBLE"}
_M9_SAID = ", ".join(f"CAST({x} AS {_M9_CASTS[c]}) AS {c}" if c in _M9_CASTS else f"{x} AS {c}" for c, x in M9_SAID.items())


@query("m9_rule_fields", f"""WITH a AS ({amounts_sql('@U u', 'text', 'row_id, text')}), s AS (SELECT *, {_M9_SAID} FROM a),
i AS (SELECT *, CASE WHEN match_type IS NOT NULL AND coalesce(match_intent, '') <> '' THEN {duck.canon_intent('match_intent', 'Record')} END AS fixed,
CASE WHEN match_record_type IS NOT NULL AND match_record_type <> '' THEN {duck.case_map('lower(trim(match_record_type))', rules.TYPE_ALIASES, 'match_record_type')}
WHEN lower(record_type_pred) = 'income' THEN 'Income' WHEN record_type_pred IS NOT NULL THEN 'Expense' END AS kind, coalesce(nullif(match_category, ''), category_pred) AS raw FROM s),
j AS (SELECT *, coalesce(fixed, intent_pred) AS intent, CASE WHEN raw IS NOT NULL AND category_item IS NOT NULL AND lower(raw) <> lower(category_item) THEN raw ELSE coalesce(category_item, raw) END AS cat FROM i)
SELECT row_id, intent, CASE WHEN fixed IS NOT NULL THEN match_score ELSE intent_prob END AS intent_confidence, CASE WHEN fixed IS NOT NULL THEN 'user_' || match_type ELSE 'tfidf' END AS intent_backend,
CASE WHEN intent = 'Record' THEN CAST(am[1] AS BIGINT) END AS amount_spent, CASE WHEN intent = 'Record' THEN kind END AS record_type,
CASE WHEN intent = 'Record' THEN CASE WHEN nullif(match_record_type, '') IS NOT NULL THEN 'user_' || match_type ELSE 'tfidf' END END AS record_type_backend,
CASE WHEN intent = 'Record' AND kind = 'Income' AND lower(cat) IN ('salary', 'bonus', 'investment', 'business') THEN lower(cat) END AS income_type,
CASE WHEN intent = 'Record' THEN item END AS item, CASE WHEN intent = 'Record' THEN cat END AS category,
CASE WHEN intent = 'Record' THEN CASE WHEN nullif(match_category, '') IS NOT NULL THEN 'user_' || match_type ELSE 'tfidf' END END AS category_backend,
CASE WHEN intent = 'Record' THEN category_item END AS category_ner, CASE WHEN intent = 'Record' THEN lower(cat) = lower(category_item) END AS category_agreement,
CASE WHEN intent = 'Action' THEN action_type_pred END AS action_type, CASE WHEN intent = 'Action' THEN CAST(am[1] AS BIGINT) END AS action_param FROM j""")
def _(t):
    said = t.U.select("row_id", "text", *[F.expr(f"CAST({x} AS {_M9_CASTS.get(c, 'STRING')})").alias(c) for c, x in M9_SAID.items()])
    return understand.decided(said).drop("text", "clean_content")
