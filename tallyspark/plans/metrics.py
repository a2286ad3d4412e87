"""Queries over statistics and evaluation: A1-A14, A18, A22-A24, A26-A27, S13, S16, M7, M11, W14."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.operators import curate, dedupe, evaluate, stats
from tallyspark.plans import duck
from tallyspark.plans.registry import query

COUNTS = """c AS (SELECT type, label, count(*) AS n FROM d WHERE type IN ('expense', 'income') GROUP BY 1, 2),
l AS (SELECT label, sum(n) AS n FROM c WHERE label IS NOT NULL GROUP BY 1),
m AS (SELECT quantile_cont(n, 0.5) AS med FROM l),
k AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n) FILTER (type = 'expense') AS BIGINT) AS expense,
      CAST(sum(n) FILTER (type = 'income') AS BIGINT) AS income FROM c)"""
DEDUPED = f"""d AS (SELECT row_id, text, CASE label WHEN 'Saving' THEN 'Savings' ELSE label END AS label, type FROM (
SELECT * FROM @U u QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1) e
QUALIFY row_number() OVER (PARTITION BY {duck.mask('text')} ORDER BY row_id) = 1)"""
RAW = "d AS (SELECT row_id, text, CASE label WHEN 'Saving' THEN 'Savings' ELSE label END AS label, type FROM @U u)"
TARGET = "CAST(greatest(2500, floor(med * 0.85)) AS BIGINT)"


def _clean(t):
    return curate.remap(t.U, "label", {"Saving": "Savings"})


@query("a1_distributions", f"""WITH {RAW} SELECT CASE WHEN g = 0 THEN 'type_label' WHEN g = 1 THEN 'type' ELSE 'label' END
AS level, type, label, n FROM (SELECT type, label, count(*) AS n, grouping(type, label) AS g FROM d
GROUP BY GROUPING SETS ((label), (type), (type, label))) x""")
def _(t):
    return stats.distributions(_clean(t))


@query("a2_balance_stats", f"""WITH {RAW}, {COUNTS} SELECT total_rows, expense, income, med AS median_label_count,
{TARGET} AS target_per_label, round(expense / greatest(income, 1), 2) AS expense_income_ratio,
CAST(floor(expense * 0.18) AS BIGINT) AS income_target,
CAST(greatest(0, floor(expense * 0.18) - income) AS BIGINT) AS income_gap FROM k, m""")
def _(t):
    return stats.balance_stats(_clean(t))


WEAK = f"""SELECT label, CAST(n AS BIGINT) AS count, {TARGET} AS target, CAST({TARGET} - n AS BIGINT) AS gap,
CASE WHEN label IN {duck.in_list(rules.INCOME_LABELS)} THEN 'income' ELSE 'expense' END AS type
FROM l, m WHERE {TARGET} - n > 0 ORDER BY gap DESC, label LIMIT 20"""


@query("a3_weak_labels", f"WITH {DEDUPED}, {COUNTS} {WEAK}")
def _(t):
    return stats.weak_labels(dedupe.dedupe_masked(t.U).transform(
        lambda d: curate.remap(d, "label", {"Saving": "Savings"})))


@query("a4_dataset_stats", f"""WITH {RAW}, l AS (SELECT label, count(*) AS n FROM d WHERE label IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS rows, (SELECT count(*) FROM d WHERE type = 'expense') AS expense,
(SELECT count(*) FROM d WHERE type = 'income') AS income,
(SELECT string_agg(label || '=' || n, ',' ORDER BY n DESC, label) FROM (SELECT * FROM l ORDER BY n DESC, label LIMIT 6) a)
AS label_top,
coalesce((SELECT string_agg(label || '=' || n, ',' ORDER BY n DESC, label)
FROM (SELECT * FROM l WHERE n < 1200 ORDER BY n DESC, label LIMIT 10) b), '') AS label_weak""")
def _(t):
    return stats.dataset_stats(_clean(t), threshold=1200)


@query("a5_sample_rare", f"""WITH {RAW}, r AS (SELECT label FROM d WHERE label IS NOT NULL GROUP BY 1
ORDER BY count(*), label LIMIT 3)
SELECT row_id, text, label FROM d WHERE label IN (SELECT label FROM r)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {duck.draw('row_id')}, row_id) <= 25""")
def _(t):
    return stats.sample_rare(_clean(t).select("row_id", "text", "label"), 25, 3)


@query("a6_accuracy", """SELECT count(*) AS rows, round(avg(CASE WHEN label_true = label_pred THEN 1.0 ELSE 0 END), 4)
AS accuracy FROM @Y y""")
def _(t):
    return evaluate.accuracy(t.Y)


@query("a7_confusion", """WITH y AS (SELECT * FROM @Y y), u AS (SELECT label_true AS l FROM y UNION SELECT label_pred FROM y)
SELECT a.l AS label_true, b.l AS label_pred, count(y.row_id) AS n FROM u a CROSS JOIN u b
LEFT JOIN y ON y.label_true = a.l AND y.label_pred = b.l GROUP BY 1, 2""")
def _(t):
    return evaluate.confusion(t.Y)


def class_sql(rel: str, keys: str = "") -> str:
    """CTE body with precision, recall, f1 and support per class of (keys, label_true, label_pred)."""
    k = keys + ", " if keys else ""
    return f"""SELECT {k}label, tp, support, predicted, coalesce(tp / nullif(predicted, 0), 0) AS precision,
coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM (
SELECT {k}label, sum(tp) AS tp, sum(s) AS support, sum(p) AS predicted FROM (
SELECT {k}label_true AS label, CASE WHEN label_true = label_pred THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS p FROM {rel}
UNION ALL SELECT {k}label_pred, 0, 0, 1 FROM {rel}) q GROUP BY {k}label) w"""


@query("a8_per_class", f"""WITH y AS (SELECT * FROM @Y y), c AS ({class_sql('y')})
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
CAST(support AS BIGINT) AS support FROM c""")
def _(t):
    return evaluate.per_class(t.Y)


AVERAGES = """round(sum(tp) / sum(support), 4) AS accuracy, CAST(sum(support) AS BIGINT) AS test_set,
round(sum(precision * support) / sum(support), 4) AS weighted_precision,
round(sum(recall * support) / sum(support), 4) AS weighted_recall,
round(sum(f1 * support) / sum(support), 4) AS weighted_f1, round(avg(precision), 4) AS macro_precision,
round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1"""


@query("a9_averages", f"WITH y AS (SELECT * FROM @Y y), c AS ({class_sql('y')}) SELECT {AVERAGES} FROM c")
def _(t):
    return evaluate.averages(t.Y)


@query("a10_calc_metrics", f"""WITH y AS (SELECT row_id, lower(label_true) AS label_true, CASE WHEN row_id % 9 = 0 THEN 'none'
ELSE lower(label_pred) END AS label_pred FROM @Y y), c AS ({class_sql('y')})
SELECT CAST(sum(support) AS BIGINT) AS rows, round(100 * sum(tp) / sum(support), 2) AS accuracy,
round(100 * avg(f1) FILTER (label NOT IN ('', 'none', 'null')), 2) AS f1 FROM c""")
def _(t):
    pairs = t.Y.withColumn("label_true", F.upper("label_true")).withColumn(
        "label_pred", F.expr("CASE WHEN row_id % 9 = 0 THEN 'None ' ELSE label_pred END"))
    return evaluate.calc_metrics(pairs)


_CATS = duck.in_list(rules.ACTIONS_WITH_CATEGORY)
HIER = f"""p AS (SELECT *, coalesce(exp_act, 'None') AS ea, coalesce(pred_act, 'None') AS pa,
CASE WHEN lower(trim(coalesce(exp_cat, 'None'))) IN ('null', 'none', '', 'nil') THEN 'None' ELSE trim(exp_cat) END AS ec,
CASE WHEN lower(trim(coalesce(pred_cat, 'None'))) IN ('null', 'none', '', 'nil') THEN 'None' ELSE trim(pred_cat) END AS pc
FROM @P p),
h AS (SELECT *, exp_intent = 'Record' OR (exp_intent = 'Action' AND ea IN {_CATS}) AS eh,
pred_intent = 'Record' OR (pred_intent = 'Action' AND pa IN {_CATS}) AS ph FROM p),
x AS (SELECT 'intent' AS task, lower(exp_intent) AS label_true, lower(pred_intent) AS label_pred FROM h
UNION ALL SELECT 'record_type', lower(CASE WHEN exp_intent = 'Record' THEN coalesce(exp_rec, 'None') ELSE 'None' END),
lower(CASE WHEN pred_intent = 'Record' THEN coalesce(pred_rec, 'None') ELSE 'None' END) FROM h
WHERE exp_intent = 'Record' OR pred_intent = 'Record'
UNION ALL SELECT 'category', lower(CASE WHEN eh THEN ec ELSE 'None' END), lower(CASE WHEN ph THEN pc ELSE 'None' END)
FROM h WHERE eh OR ph
UNION ALL SELECT 'action_type', lower(CASE WHEN exp_intent = 'Action' THEN ea ELSE 'None' END),
lower(CASE WHEN pred_intent = 'Action' THEN pa ELSE 'None' END) FROM h
WHERE exp_intent = 'Action' OR pred_intent = 'Action')"""


@query("a11_eval_hierarchical", f"""WITH {HIER}, c AS ({class_sql('x', 'task')})
SELECT task, CAST(sum(support) AS BIGINT) AS rows, round(100 * sum(tp) / sum(support), 2) AS accuracy,
round(100 * avg(f1) FILTER (label NOT IN ('', 'none', 'null')), 2) AS f1 FROM c GROUP BY task""")
def _(t):
    return evaluate.eval_hierarchical(t.P)


@query("a12_latency", """SELECT backend, count(*) AS rows, round(avg(latency_ms), 6) AS avg_latency_ms,
round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM @P p GROUP BY backend""")
def _(t):
    return evaluate.latency(t.P, digits=6)  # six digits: two would hang on binary ties


@query("a13_eval_exact", f"""WITH p AS (SELECT *, coalesce(exp_cat, 'None') AS ec, coalesce(nullif(pred_cat, ''), 'None') AS pc,
coalesce(exp_act, 'None') AS ea, coalesce(pred_act, 'None') AS pa FROM @P p),
x AS (SELECT 'intent' AS task, exp_intent AS label_true, pred_intent AS label_pred FROM p
      UNION ALL SELECT 'category', ec, pc FROM p WHERE exp_intent = 'Record'),
c AS ({class_sql('x', 'task')}), m AS (SELECT task, avg(f1) AS m FROM c GROUP BY 1)
SELECT round(100 * avg(CASE WHEN exp_intent = pred_intent THEN 1.0 ELSE 0 END), 2) AS accuracy,
round(100 * avg(CASE WHEN exp_intent = pred_intent AND CASE exp_intent WHEN 'Record' THEN ec = pc AND exp_amount = pred_amount
WHEN 'Action' THEN ea = pa ELSE true END THEN 1.0 ELSE 0 END), 2) AS exact_match,
round(100 * avg(CASE WHEN json_valid(raw_json) THEN 1.0 ELSE 0 END), 2) AS json_valid,
(SELECT round(100 * sum(m) / 2, 2) FROM m) AS f1 FROM p""")
def _(t):
    return evaluate.eval_exact(t.P)


@query("a18_length_stats", """SELECT count(*) AS rows, round(avg(length(text)), 4) AS mean_length,
count(*) FILTER (length(text) > 60) AS over_limit FROM documents""")
def _(t):
    return stats.length_stats(t.documents)


CASES = """SELECT row_id, concat('tag', row_id % 6) AS tag, exp_intent AS intent, exp_cat AS category, exp_rec AS record_type"""
ERRORS = """SELECT row_id, concat('tag', row_id % 6) AS tag, concat_ws(', ',
CASE WHEN exp_intent IS DISTINCT FROM pred_intent THEN concat('intent=', coalesce(pred_intent, 'None'), '!=', exp_intent) END,
CASE WHEN coalesce(exp_cat, '') <> '' AND exp_cat IS DISTINCT FROM pred_cat
     THEN concat('category=', coalesce(pred_cat, 'None'), '!=', exp_cat) END,
CASE WHEN coalesce(exp_rec, '') <> '' AND exp_rec IS DISTINCT FROM pred_rec
     THEN concat('record_type=', coalesce(pred_rec, 'None'), '!=', exp_rec) END) AS errors FROM @P p"""


def _report(t):
    preds = t.P.selectExpr("row_id", "pred_intent AS intent", "pred_cat AS category", "pred_rec AS record_type")
    cases = t.P.selectExpr("row_id", "concat('tag', row_id % 6) AS tag", "exp_intent AS intent", "exp_cat AS category",
                           "exp_rec AS record_type")
    return evaluate.regression_report(preds, cases)


@query("a22_regression_report", f"SELECT * FROM ({ERRORS}) e WHERE errors <> ''")
def _(t):
    return _report(t)


@query("a22_failed_tags", f"SELECT tag, count(*) AS failed FROM ({ERRORS}) e WHERE errors <> '' GROUP BY 1")
def _(t):
    return evaluate.failed_tags(_report(t))


def _runs(t):
    return t.F.selectExpr("row_id AS run_id", "ts AS trained_at",
                          "CASE WHEN log_type = 'dislike' THEN 'failed' ELSE 'success' END AS status",
                          "CASE WHEN row_id % 3 = 0 THEN NULL ELSE (row_id % 1000) / 1000D END AS weighted_f1",
                          "CASE WHEN row_id % 6 = 0 THEN 87.125D ELSE 0.5D END AS accuracy")


@query("a23_history", """WITH r AS (SELECT row_id AS run_id, ts, log_type, count(*) OVER () - row_number() OVER (ORDER BY ts DESC,
row_id DESC) + 1 AS run_index, CASE WHEN row_id % 3 = 0 THEN CASE WHEN row_id % 6 = 0 THEN 87.125 ELSE 50.0 END
ELSE (row_id % 1000) / 10.0 END AS v FROM @F f)
SELECT run_id, run_index, CASE WHEN log_type = 'dislike' THEN 'failed' ELSE 'success' END AS status,
CASE WHEN log_type <> 'dislike' THEN printf('%.1f', CAST(v AS DOUBLE)) END AS f1_score FROM r
WHERE run_index > (SELECT count(*) FROM @F g) - 100""")
def _(t):
    return evaluate.history(_runs(t))


@query("w14_latest_run", """SELECT count(*) AS runs, max(ts || '') IS NOT NULL AS has_runs, arg_max(row_id, row_id) AS latest_run
FROM @F f""")
def _(t):
    runs = _runs(t)
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.max("trained_at").isNotNull().alias("has_runs"),
                    F.max_by("run_id", F.struct("trained_at", "run_id")).alias("latest_run"))


@query("a24_quota", """WITH c AS (SELECT count(*) AS rows, count(*) FILTER (lower(type) = 'income') AS income FROM @U u)
SELECT rows, income, CAST(greatest(1, round_even(4000 * income / rows, 0)) AS BIGINT) AS target_income,
CAST(4000 - greatest(1, round_even(4000 * income / rows, 0)) AS BIGINT) AS target_expense FROM c""")
def _(t):
    return stats.quota(t.U, 4000)


_SLOTS = [c for c in rules.SLOT_COLUMNS if c != "note"]


@query("a26_slot_summary", "SELECT field, count(*) AS samples, count(DISTINCT v) AS classes FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, {duck.blank(c)} AS v FROM @A a" for c in _SLOTS) + ") x WHERE v IS NOT NULL GROUP BY 1")
def _(t):
    return stats.slot_summary(t.A, _SLOTS)


@query("a27_change_stats", f"""SELECT count(*) FILTER (type IS DISTINCT FROM nt) AS type_changed,
count(*) FILTER (label IS DISTINCT FROM nl) AS label_changed FROM (
SELECT type, label, {duck.TYPE_FIXED} AS nt, {duck.LABEL_FIXED} AS nl FROM @U u) x""")
def _(t):
    return curate.change_stats(t.U, curate.fix_type_label(t.U))


@query("s16_corpus_counts", """SELECT 'record' AS source, count(*) AS n FROM @U u UNION ALL SELECT 'action', count(*) FROM @A a
UNION ALL SELECT 'log', count(*) FROM @F f
UNION ALL SELECT 'total', (SELECT count(*) FROM @U u) + (SELECT count(*) FROM @A a) + (SELECT count(*) FROM @F f)""")
def _(t):
    return stats.corpus_counts({"record": t.U, "action": t.A, "log": t.F})


@query("m7_review_route", """SELECT row_id, label_pred, CASE WHEN conf IS NULL OR conf < 0.65 THEN 'review' ELSE 'accept' END AS route
FROM (SELECT row_id, label_pred, CASE WHEN row_id % 10 <> 0 THEN (row_id % 100) / 100.0 END AS conf FROM @Y y) x""")
def _(t):
    from tallyspark.operators.ml import review_route
    rows = t.Y.selectExpr("row_id", "label_pred", "CASE WHEN row_id % 10 <> 0 THEN (row_id % 100) / 100D END AS confidence")
    return review_route(rows).drop("confidence")


@query("m11_task_metrics", f"WITH {HIER}, c AS ({class_sql('x', 'task')}) SELECT task, {AVERAGES} FROM c GROUP BY task")
def _(t):
    pairs = evaluate.hierarchical_pairs(t.P)
    low = pairs.withColumn("label_true", F.lower("label_true")).withColumn("label_pred", F.lower("label_pred"))
    return evaluate.averages(low, ["task"])
