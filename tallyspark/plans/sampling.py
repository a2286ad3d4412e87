"""Queries over samples, splits and quotas: K1-K3, K5-K15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.operators import sample
from tallyspark.plans import duck
from tallyspark.plans.registry import query

D = duck.draw("row_id")


@query("k1_top_k", "SELECT label, count(*) AS n FROM @U u WHERE label IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def _(t):
    counts = t.U.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sample.top_k(counts, [F.desc("n"), "label"], 5)


@query("k2_first_mismatches", """SELECT row_id, label_true, label_pred FROM @Y y WHERE lower(label_true) <> lower(label_pred)
ORDER BY row_id LIMIT 5""")
def _(t):
    return sample.first_mismatches(t.Y)


@query("k3_head_per_source", """SELECT row_id, text, label, type FROM @U u WHERE text <> '' AND label <> ''
QUALIFY row_number() OVER (PARTITION BY type ORDER BY row_id) <= 100""")
def _(t):
    return sample.head_per_source(t.U.select("row_id", "text", "label", "type"), "type")


@query("k5_subsample", f"""WITH u AS (SELECT row_id, label FROM @U u WHERE label IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {D}, row_id) AS rn FROM u),
k AS (SELECT row_id, label FROM r WHERE rn <= 3000 // (SELECT count(DISTINCT label) FROM u))
SELECT row_id, label FROM k ORDER BY {D}, row_id LIMIT 3000""")
def _(t):
    return sample.subsample_by_label(t.U.select("row_id", "label").filter("label IS NOT NULL"), "label", 3000)


@query("k6_oversample", f"""WITH u AS (SELECT row_id, type FROM @U u WHERE type IN ('income', 'expense')),
r AS (SELECT row_id, row_number() OVER (ORDER BY {D}, row_id) AS rn, count(*) OVER () AS c FROM u WHERE type = 'income'),
g AS (SELECT *, greatest(c, CAST(floor((SELECT count(*) FROM u WHERE type = 'expense') * 0.5) AS BIGINT)) AS goal FROM r)
SELECT row_id, type, 1 AS copy FROM u WHERE type = 'expense'
UNION ALL SELECT row_id, 'income', unnest(range(1, CAST(goal // c + CASE WHEN rn <= goal % c THEN 1 ELSE 0 END + 1 AS BIGINT)))
FROM g""")
def _(t):
    rows = t.U.filter("type IN ('income', 'expense')").select("row_id", "type")
    return sample.oversample(rows, "type", "income", F.floor(F.element_at("_sizes", F.lit("expense")) * 0.5))


@query("k7_stratified_split", f"""SELECT row_id, label_true, CASE WHEN row_number() OVER (PARTITION BY label_true ORDER BY {D}, row_id)
<= floor(count(*) OVER (PARTITION BY label_true) * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM @Y y""")
def _(t):
    return sample.stratified_split(t.Y.select("row_id", "label_true"), "label_true")


@query("k8_key_split", """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(concat('42:', doc_id)), 1, 8) AS BIGINT) % 100 < 10
THEN 'test' ELSE 'train' END AS split FROM documents""")
def _(t):
    return sample.key_split(t.documents.select("doc_id"), "doc_id", 10)


@query("k9_label_cap", f"""WITH c AS (SELECT row_id, label FROM @U u WHERE label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {D}, row_id) <= 500)
SELECT row_id, label FROM c ORDER BY {D}, row_id LIMIT 2000""")
def _(t):
    rows = t.U.select("row_id", "label").filter("label IS NOT NULL")
    return sample.global_cap(sample.cap_per_label(rows, "label", 500), 2000)


@query("k10_fixed_sample", f"""SELECT doc_id, lang FROM documents WHERE n_chars > 100
ORDER BY {duck.draw('doc_id')}, doc_id LIMIT 200""")
def _(t):
    return sample.fixed_sample(t.documents.filter("n_chars > 100").select("doc_id", "lang"), 200, "doc_id")


@query("k11_replicate", """SELECT row_id, text, unnest([1, 2, 3]) AS copy FROM @U u WHERE contains(text, 'karaoke')""")
def _(t):
    return sample.replicate(t.U.filter(F.contains("text", F.lit("karaoke"))).select("row_id", "text"), 3)


@query("k12_scale_quotas", """WITH q AS (SELECT label AS key, rank() OVER (ORDER BY label) AS pos, count(*) AS quota FROM @U u
WHERE label IS NOT NULL GROUP BY 1),
s AS (SELECT *, greatest(1, CAST(round_even(quota * 777 / (SELECT sum(quota) FROM q), 0) AS BIGINT)) AS n,
pos = (SELECT max(pos) FROM q) AS last FROM q)
SELECT key, pos, CAST(CASE WHEN last THEN greatest(0, 777 - (SELECT sum(n) FROM s WHERE NOT last)) ELSE n END AS BIGINT) AS quota
FROM s""")
def _(t):
    from pyspark.sql import Window
    counts = t.U.filter("label IS NOT NULL").groupBy(F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("quota"))
    return sample.scale_quotas(counts.withColumn("pos", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("key"))), 777)


@query("k13_fill_to_quota", """SELECT row_id, type FROM @U u QUALIFY row_number() OVER (PARTITION BY type ORDER BY row_id)
<= CASE type WHEN 'income' THEN 700 WHEN 'expense' THEN 3300 ELSE 0 END""")
def _(t):
    quotas = t.spark.createDataFrame([("income", 700), ("expense", 3300)], "key STRING, quota BIGINT")
    return sample.fill_to_quota(t.U.select("row_id", "type"), quotas, "type")


THEMES = list(rules.THEME_QUOTAS_10K)


@query("k14_theme_quotas", f"""WITH u AS (SELECT row_id, text, [{', '.join(duck.lit(x) for x in THEMES)}][row_id % 16 + 1] AS theme
FROM @U u)
SELECT row_id, theme FROM u QUALIFY row_number() OVER (PARTITION BY theme ORDER BY row_id)
<= {'CASE theme ' + ' '.join(f"WHEN '{k}' THEN {v // 2}" for k, v in rules.THEME_QUOTAS_10K.items()) + ' END'}""")
def _(t):
    quotas = t.spark.createDataFrame([(k, v // 2) for k, v in rules.THEME_QUOTAS_10K.items()], "key STRING, quota BIGINT")
    theme = F.element_at(F.array(*map(F.lit, THEMES)), (F.col("row_id") % 16 + 1).cast("int"))
    return sample.fill_to_quota(t.U.select("row_id", theme.alias("theme")), quotas, "theme")


@query("k15_shuffle", f"SELECT row_id, {D} AS draw FROM @U u")
def _(t):
    return sample.shuffle(t.U.select("row_id"))
