"""Queries over the column functions: F1-F12, F22-F38, F41-F47, J16, J17, A25, K4, W12, W13, M8, M10, J6, R15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import context as cx
from tallyspark.functions import money, payload, timeparse
from tallyspark.functions import text as tx
from tallyspark.operators import baseline, ledger, similarity
from tallyspark.plans import duck
from tallyspark.plans.registry import query

UNIT = "CASE " + " ".join(f"WHEN u IN {duck.in_list(names)} THEN {mult}" for mult, names in rules.UNIT_VALUES.items()) + " ELSE 1 END"


def amounts_sql(rel: str, text: str, keys: str) -> str:
    """SELECT of (keys, s, am): all amounts of a text without number words."""
    comp = duck.lit(r"(?i)([0-9]+)\s*(?:tr|trieu|triệu)\s*([0-9]{1,3})(?:[^0-9]|$)")
    unit = duck.lit(rf"(?i)([0-9]+(?:[.,][0-9]+)?)\s*({rules.AMOUNT_UNITS})")
    plain = duck.lit(r"(?:^|[^0-9.])([0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{4,})")
    return f"""SELECT {keys}, s, list_concat(list_concat(
[CAST(a[i] AS BIGINT) * 1000000 + CAST(b[i] AS BIGINT) * CASE WHEN length(b[i]) = 1 THEN 100000 ELSE 1000 END for i in range(1, len(a) + 1)],
[CAST(round_even(CAST(replace(n[i], ',', '.') AS DOUBLE) * list_extract([{UNIT} for u in v], i), 0) AS BIGINT) for i in range(1, len(n) + 1)]),
[CAST(replace(replace(x, '.', ''), ',', '') AS BIGINT) for x in p]) AS am FROM (
SELECT {keys}, s, regexp_extract_all(s, {comp}, 1) AS a, regexp_extract_all(s, {comp}, 2) AS b, regexp_extract_all(s, {unit}, 1) AS n,
regexp_extract_all(s, {unit}, 2) AS v, regexp_extract_all(s, {plain}, 1) AS p FROM (SELECT {keys}, lower(trim({text})) AS s FROM {rel}) q0) q1"""


# --- text ------------------------------------------------------------------------------------------
@query("f1_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.strip_accents(F.col("text"))).alias("h"))


@query("f2_collapse_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.collapse_ws(F.col("text"))).alias("h"))


@query("f3_mask_amounts", f"SELECT row_id, {duck.mask('text')} AS masked FROM @U u")
def _(t):
    return t.U.select("row_id", tx.mask_amounts(F.col("text")).alias("masked"))


SLANG = "concat(CASE row_id % 6 WHEN 0 THEN 'hai củ rưỡi' WHEN 1 THEN 'nửa triệu' WHEN 2 THEN 'năm chục' WHEN 3 THEN 'củ rưỡi' WHEN 4 THEN 'ba người' ELSE concat(row_id % 9, ' củ rưỡi') END, ' x')"


@query("f4_preprocess_slang", """SELECT row_id, concat(CASE row_id % 6 WHEN 0 THEN '2.5 triệu' WHEN 1 THEN '500k' WHEN 2 THEN '5 chục'
WHEN 3 THEN '1.5 triệu' WHEN 4 THEN 'ba người' ELSE concat(row_id % 9, '.5 triệu') END, ' x') AS text FROM @U u""")
def _(t):
    return t.U.select("row_id", money.preprocess_slang(F.expr(SLANG)).alias("text"))


@query("f5_extract_amounts", f"SELECT row_id, array_to_string(am, ',') AS amounts FROM ({amounts_sql('@U u', 'text', 'row_id')}) x")
def _(t):
    return t.U.select("row_id", F.array_join(F.transform(money.extract_amounts(F.col("text")), lambda v: v.cast("string")), ",").alias("amounts"))


PLAIN = "CASE row_id % 4 WHEN 0 THEN concat(row_id % 900 + 1, '.000') WHEN 1 THEN concat(row_id % 9, ',000,000') WHEN 2 THEN concat(row_id % 7, '.500,00') ELSE CASE WHEN row_id % 8 = 3 THEN concat(row_id % 9, ',234.567') ELSE 'x' END END"


@query("f6_parse_plain_amount", f"SELECT row_id, CASE WHEN v > 0 THEN v END AS amount FROM (SELECT row_id, CASE WHEN strpos(p, ',') > 0 AND strpos(reverse(p), '.') BETWEEN 1 AND strpos(reverse(p), ',') THEN NULL ELSE TRY_CAST(replace(replace(p, '.', ''), ',', '') AS BIGINT) END AS v FROM (SELECT row_id, {PLAIN} AS p FROM @U u) y) x")
def _(t):
    return t.U.select("row_id", money.parse_plain_amount(F.expr(PLAIN)).alias("amount"))


@query("f7_clean_content", f"""SELECT row_id, {duck.ws(duck.rsub('lower(trim(text))', rf'[0-9]+(?:[.,][0-9]+)?\s*(?:{rules.AMOUNT_UNITS})', ' '))} AS content FROM @U u""")
def _(t):
    return t.U.select("row_id", money.clean_content(F.col("text")).alias("content"))


@query("f8_clean_category_text", f"SELECT row_id, {duck.clean_category('text')} AS text FROM (SELECT row_id, concat(text, ' momo x tiền mặt') AS text FROM @U u) x")
def _(t):
    return t.U.select("row_id", tx.clean_category_text(F.concat("text", F.lit(" momo x tiền mặt"))).alias("text"))


@query("f9_ascii_tokens", """SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS h FROM (SELECT doc_id,
[x for x in string_split(trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-zA-Z_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if x <> ''] AS w
FROM documents) d""")
def _(t):
    rows = t.documents.select("doc_id", tx.ascii_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))


@query("f10_strip_hash_id", f"SELECT row_id, {duck.strip_hash('text')} AS text FROM @U u")
def _(t):
    return t.U.select("row_id", tx.strip_hash_id(F.col("text")).alias("text"))


SEG = r"'(?i)\s*[,;|]\s*|\n\s*|\s+và\s+|\s+\+\s+'"


@query("f11_split_segments", f"SELECT row_id, array_to_string([trim(x) for x in string_split_regex(trim(text), {SEG}) if trim(x) <> ''], '|') AS parts FROM @U u")
def _(t):
    return t.U.select("row_id", F.array_join(tx.split_segments(F.col("text")), "|").alias("parts"))


MULTI = f"""WITH g AS (SELECT row_id, unnest(string_split_regex(trim(text), {SEG})) AS seg FROM @U u),
a AS ({amounts_sql('(SELECT row_id, trim(seg) AS seg FROM g) g2', 'seg', 'row_id, seg')}),
k AS (SELECT row_id, seg, am[1] AS amount, count(*) OVER (PARTITION BY row_id) AS n FROM a WHERE len(am) > 0)"""


@query("f12_multi_records", f"{MULTI} SELECT row_id, seg AS segment, amount FROM k WHERE n >= 2")
def _(t):
    return baseline.multi_records(t.U).select("row_id", "segment", "amount")


# --- time ------------------------------------------------------------------------------------------
PHRASE = """CASE row_id % 17 WHEN 0 THEN 'hôm nay' WHEN 1 THEN 'Hôm qua tiêu gì' WHEN 2 THEN 'tuần trước' WHEN 3 THEN 'Tuần này' WHEN 4 THEN 'tháng trước'
WHEN 5 THEN 'tháng này' WHEN 6 THEN 'quý này' WHEN 7 THEN concat(1 + row_id % 40, ' ngày qua') WHEN 8 THEN '30 ngày' WHEN 9 THEN 'cuối tuần'
WHEN 10 THEN 'ngày thường' WHEN 11 THEN 'thứ tư' WHEN 12 THEN 'Chủ nhật' WHEN 13 THEN 'từ ngày 3 đến ngày 17 tháng trước'
WHEN 14 THEN 'từ 05/02 đến 20/03/1998' WHEN 15 THEN 'năm' ELSE 'xóa giao dịch' END"""
M = "date_trunc('month', d)"
WK = "date_trunc('week', d)"
RANGES = f"""SELECT *, CASE row_id % 17 WHEN 0 THEN 'day' WHEN 1 THEN 'yesterday' WHEN 2 THEN 'last_week' WHEN 3 THEN 'week' WHEN 4 THEN 'last_month' WHEN 5 THEN 'month'
WHEN 6 THEN 'quarter' WHEN 7 THEN concat('rolling_', 1 + row_id % 40, 'd') WHEN 8 THEN 'rolling_30d' WHEN 9 THEN 'weekend' WHEN 10 THEN 'weekday'
WHEN 11 THEN 'wednesday' WHEN 12 THEN 'sunday' WHEN 13 THEN 'custom' WHEN 14 THEN 'custom' WHEN 15 THEN 'year' END AS granularity,
CAST(CASE row_id % 17 WHEN 0 THEN d WHEN 1 THEN d - INTERVAL 1 DAY WHEN 2 THEN {WK} - INTERVAL 7 DAY WHEN 3 THEN {WK} WHEN 4 THEN {M} - INTERVAL 1 MONTH WHEN 5 THEN {M}
WHEN 6 THEN date_trunc('quarter', d) WHEN 7 THEN d - to_days(CAST(row_id % 40 AS INT)) WHEN 8 THEN d - INTERVAL 29 DAY WHEN 9 THEN {WK} + INTERVAL 5 DAY WHEN 10 THEN {WK}
WHEN 11 THEN {WK} + INTERVAL 2 DAY WHEN 12 THEN {WK} + INTERVAL 6 DAY WHEN 13 THEN {M} - INTERVAL 1 MONTH + INTERVAL 2 DAY
WHEN 14 THEN make_date(year(d), 2, 5) WHEN 15 THEN date_trunc('year', d) END AS DATE) AS s,
CAST(CASE row_id % 17 WHEN 1 THEN d - INTERVAL 1 DAY WHEN 2 THEN {WK} - INTERVAL 1 DAY WHEN 4 THEN {M} - INTERVAL 1 DAY WHEN 9 THEN {WK} + INTERVAL 6 DAY
WHEN 10 THEN {WK} + INTERVAL 4 DAY WHEN 11 THEN {WK} + INTERVAL 2 DAY WHEN 12 THEN {WK} + INTERVAL 6 DAY WHEN 13 THEN {M} - INTERVAL 1 MONTH + INTERVAL 16 DAY
WHEN 14 THEN DATE '1998-03-20' WHEN 16 THEN NULL ELSE d END AS DATE) AS e
FROM (SELECT *, CAST(ts AS DATE) AS d FROM @L l0) l"""


@query("f22_parse_time_range", f"SELECT row_id, granularity, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS \"end\" FROM ({RANGES}) x")
def _(t):
    return timeparse.with_time_range(t.L, F.expr(PHRASE), F.col("ts"), "r").select("row_id", F.col("r.granularity").alias("granularity"), F.col("r.start").cast("string").alias("start"), F.col("r.end").cast("string").alias("end"))


_LABEL_OF = "CASE " + " ".join(f"WHEN granularity = {duck.lit(k)} THEN {duck.lit(v)}" for k, v in timeparse.LABELS.items()) + (
    " WHEN granularity = 'custom' THEN concat('Từ ', strftime(s, '%d/%m'), ' đến ', strftime(e, '%d/%m/%Y')) WHEN starts_with(granularity, 'rolling_') "
    "THEN concat(regexp_extract(granularity, '[0-9]+'), ' ngày qua') END")


@query("f22_period_label", f"""SELECT row_id, concat({_LABEL_OF}, ' (', CASE WHEN s = e THEN '' ELSE concat(strftime(s, '%d/%m'), ' - ') END, strftime(e, '%d/%m/%Y'), ')') AS label
FROM ({RANGES}) x WHERE granularity IS NOT NULL""")
def _(t):
    rows = timeparse.with_time_range(t.L, F.expr(PHRASE), F.col("ts"), "r").filter("r IS NOT NULL")
    return rows.select("row_id", timeparse.period_label(F.col("r")).alias("label"))


PHRASES = "SELECT user_id, row_id, ts FROM @L p0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY row_id) = 1"


def _phrases(t):
    first = t.L.groupBy("user_id").agg(F.min(F.struct("row_id", "ts")).alias("f"))
    return first.select("user_id", F.col("f.row_id").alias("row_id"), F.col("f.ts").alias("anchor"))


@query("j16_rows_in_phrase", f"""WITH x AS ({RANGES.replace('@L l0', f'({PHRASES}) l0')})
SELECT l.row_id, l.user_id, l.amount, x.granularity FROM @L l JOIN x ON l.user_id = x.user_id
AND l.ts >= x.s AND l.ts < x.e + INTERVAL 1 DAY""")
def _(t):
    phrases = _phrases(t).select("user_id", F.expr(PHRASE).alias("phrase"), "anchor")
    return ledger.rows_in_phrase(t.L, phrases).select("row_id", "user_id", "amount", "granularity")


@query("j17_compare_periods", f"""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS d FROM ({PHRASES}) z),
x AS (SELECT l.user_id, CAST(coalesce(sum(amount) FILTER (ts >= {M} AND ts < d + INTERVAL 1 DAY), 0) AS BIGINT) AS first,
CAST(coalesce(sum(amount) FILTER (ts >= {M} - INTERVAL 1 MONTH AND ts < {M}), 0) AS BIGINT) AS second FROM @L l JOIN p ON l.user_id = p.user_id
WHERE type = 'expense' AND ts >= {M} - INTERVAL 1 MONTH AND ts < d + INTERVAL 1 DAY GROUP BY 1)
SELECT 1 AS request_id, user_id, first, second, first - second AS delta, round(100.0 * (first - second) / nullif(second, 0), 2) AS percent FROM x
UNION ALL SELECT 2, user_id, second, first, second - first, round(100.0 * (second - first) / nullif(first, 0), 2) FROM x""")
def _(t):
    asked = F.posexplode(F.array(F.lit("tháng này vs tháng trước"), F.lit("tháng trước vs tháng này"))).alias("i", "slot")
    slots = _phrases(t).select("user_id", "anchor", asked).select((F.col("i") + 1).alias("request_id"), "user_id", "slot", "anchor")
    return ledger.compare_periods(t.L, slots)


# --- profile and context ---------------------------------------------------------------------------
ASOF = "1998-07-22"


def _profile(t):
    budgets = t.table("customer").select(F.col("c_custkey").alias("user_id"), (F.lit(200_000.0) + 10 * F.col("c_custkey")).alias("budget_total"))
    return ledger.profile(t.L, ASOF, budgets)


PROFILE = f"""c AS (SELECT user_id, category, sum(amount) FILTER (CAST(ts AS DATE) = DATE '{ASOF}') AS t,
sum(amount) FILTER (CAST(ts AS DATE) >= date_trunc('week', DATE '{ASOF}')) AS w, sum(amount) FILTER (CAST(ts AS DATE) >= date_trunc('month', DATE '{ASOF}')) AS m,
count(*) FILTER (CAST(ts AS DATE) >= date_trunc('week', DATE '{ASOF}')) AS f FROM @L l WHERE type = 'expense' AND CAST(ts AS DATE) <= DATE '{ASOF}'
AND CAST(ts AS DATE) >= least(date_trunc('month', DATE '{ASOF}'), date_trunc('week', DATE '{ASOF}')) GROUP BY 1, 2),
g AS (SELECT user_id, CAST(coalesce(sum(t), 0) AS BIGINT) AS spent_today, CAST(coalesce(sum(w), 0) AS BIGINT) AS spent_week,
CAST(coalesce(sum(m), 0) AS BIGINT) AS spent_month FROM c GROUP BY 1),
p AS (SELECT g.*, 200000.0 + 10 * user_id AS budget_total, greatest(0.0, 200000.0 + 10 * user_id - spent_month) AS budget_remain FROM g)"""


@query("a25_profile", f"""WITH {PROFILE}, s AS (SELECT c.user_id, string_agg(concat(category, ':', f, ':', printf('%.1f', round(coalesce(100.0 * m / nullif(spent_month, 0), 0), 1))), ',' ORDER BY category) AS stats
FROM c JOIN g ON c.user_id = g.user_id GROUP BY 1) SELECT p.*, stats FROM p JOIN s ON p.user_id = s.user_id""")
def _(t):
    stats = F.array_join(F.transform(F.array_sort(F.map_entries("category_stats")), lambda e: F.concat(
        e["key"], F.lit(":"), e["value"]["frequency_week"].cast("string"), F.lit(":"), F.format_string("%.1f", e["value"]["pct"]))), ",")
    return _profile(t).withColumn("stats", stats).drop("category_stats")


@query("f23_time_and_wallet", f"""WITH {PROFILE} SELECT user_id, CASE WHEN user_id % 24 BETWEEN 5 AND 10 THEN 'sáng_sớm' WHEN user_id % 24 BETWEEN 11 AND 13 THEN 'buổi_trưa'
WHEN user_id % 24 BETWEEN 14 AND 18 THEN 'chiều_tối' ELSE 'đêm_muộn' END AS tod,
CASE WHEN 1 + user_id % 31 <= 15 THEN 15 - (1 + user_id % 31) ELSE greatest(0, 30 - (1 + user_id % 31)) END AS payday,
CASE WHEN budget_remain / budget_total >= 0.5 THEN 'an_toan' WHEN budget_remain / budget_total >= 0.2 THEN 'can_than' ELSE 'bao_dong' END AS health FROM p""")
def _(t):
    uid = F.col("user_id")
    return _profile(t).select("user_id", cx.time_of_day(uid % 24).alias("tod"), cx.days_to_payday(1 + uid % 31).alias("payday"),
                              cx.wallet_health(F.col("budget_remain"), F.col("budget_total")).alias("health"))


RECORD = """l.row_id, l.user_id, l.amount, coalesce(c.f, 0) AS freq, coalesce(round(100.0 * c.m / nullif(p.spent_month, 0), 1), 0) AS pct, l.category, budget_remain, budget_total
FROM @L l JOIN p ON l.user_id = p.user_id LEFT JOIN c ON l.user_id = c.user_id AND l.category = c.category WHERE l.type = 'expense'"""


def _records(t):
    rows = t.L.filter("type = 'expense'").join(_profile(t), "user_id")
    stat = lambda f: cx.category_stat(F.col("category_stats"), F.col("category"), f)
    return rows.withColumn("freq", stat("frequency_week")).withColumn("pct", stat("pct"))


@query("f24_trigger", f"""WITH {PROFILE}, r AS (SELECT {RECORD}), k AS (SELECT row_id, CASE WHEN amount > 300000 THEN 'WARNING_AMOUNT' WHEN amount > budget_remain THEN 'OVER_BUDGET'
WHEN budget_remain / budget_total < 0.2 THEN 'WARNING_BUDGET' WHEN freq > 3 THEN 'WARNING_FREQUENCY' END AS type FROM r)
SELECT row_id, type IS NOT NULL AS is_triggered, type FROM k""")
def _(t):
    trig = cx.trigger(F.col("amount"), F.lit(300_000), F.col("budget_remain"), F.col("budget_total"), F.col("freq"))
    return _records(t).select("row_id", trig.alias("t")).select("row_id", "t.*")


@query("f25_expense_facts", f"""WITH {PROFILE}, r AS (SELECT {RECORD}), k AS (SELECT *, budget_remain / budget_total AS ratio, 1 + row_id % 31 AS day FROM r),
d AS (SELECT *, CASE WHEN day <= 15 THEN 15 - day ELSE greatest(0, 30 - day) END AS pd FROM k),
f AS (SELECT row_id, [x for x in [CASE WHEN ratio < 0.2 THEN 'alarm' WHEN ratio < 0.5 THEN 'half' END,
CASE WHEN pct > 30 THEN 'share30' WHEN pct > 15 THEN 'share15' END, CASE WHEN freq > 4 THEN 'often' END, CASE WHEN pd = 0 THEN 'payday' WHEN pd <= 3 THEN 'near' END] if x IS NOT NULL] AS fs FROM d)
SELECT row_id, CASE WHEN len(fs) > 0 THEN array_to_string(fs[1:2], '+') END AS facts FROM f""")
def _(t):
    fact = cx.expense_facts(F.col("budget_remain"), F.col("budget_total"), F.col("pct"), F.col("freq"), F.col("day"), F.col("category"))
    rows = _records(t).withColumn("day", 1 + F.col("row_id") % 31).select("row_id", fact.alias("fact"))
    marks = {"alarm": "Cảnh báo báo động", "half": "Cảnh báo nhẹ", "share30": "cực kỳ lớn", "share15": "khá cao", "often": "Bạn đã chi cho", "payday": "Hôm nay là ngày nhận lương", "near": "nữa là tới ngày nhận lương"}
    names = F.array_compact(F.array(*[F.when(F.contains("fact", F.lit(v)), F.lit(k)) for k, v in marks.items()]))
    return rows.select("row_id", F.when(F.col("fact").isNotNull(), F.array_join(names, "+")).alias("facts"))


@query("f26_change_trigger", """SELECT row_id, CASE WHEN value IS NOT NULL AND old <> 0 AND abs(value - old) / greatest(old, 1) >= 0.5 THEN 'WARNING_CHANGE' END AS type
FROM (SELECT row_id, try_cast(value AS DOUBLE) AS value, (row_id % 5) * 50000 AS old FROM @A a) x WHERE value IS NULL OR NOT isnan(value)""")
def _(t):
    rows = t.A.select("row_id", F.col("value").try_cast("double").alias("v"), ((F.col("row_id") % 5) * 50_000).alias("old"))
    rows = rows.filter("v IS NULL OR NOT isnan(v)")
    return rows.select("row_id", cx.change_trigger(F.col("v"), F.col("old")).alias("type"))


@query("f42_category_stat", f"WITH {PROFILE}, r AS (SELECT {RECORD}) SELECT row_id, freq, CAST(pct AS DOUBLE) AS pct FROM r")
def _(t):
    return _records(t).select("row_id", "freq", "pct")


MENTION = "concat(text, CASE row_id % 5 WHEN 0 THEN ' trời mưa' WHEN 1 THEN ' chưa có Lương' WHEN 2 THEN ' so với tháng trước' ELSE '' END)"


@query("f43_mentioned_fields", "SELECT row_id, array_to_string([x for x in [" + ", ".join(
    f"CASE WHEN {duck.contains_any(f'lower({MENTION})', words)} THEN '{name}' END" for name, words in cx.MENTIONS.items()) + "] if x IS NOT NULL], ',') AS fields FROM @U u")
def _(t):
    return t.U.select("row_id", cx.mentioned_fields(F.expr(MENTION)).alias("fields"))


@query("f44_context_json", f"""WITH {PROFILE} SELECT user_id, concat('{{"time_of_day":"', CASE WHEN user_id % 24 BETWEEN 5 AND 10 THEN 'Sáng sớm' WHEN user_id % 24 BETWEEN 11 AND 13 THEN 'Trưa nắng'
WHEN user_id % 24 BETWEEN 14 AND 18 THEN 'Chiều muộn' ELSE 'Đêm khuya' END, '","weather":"nắng ấm","wallet_health":"', CASE WHEN budget_remain / budget_total >= 0.5 THEN 'rủng rỉnh'
WHEN budget_remain / budget_total >= 0.2 THEN 'tạm ổn' ELSE 'đang báo động' END, '","days_to_payday":"', CASE WHEN 1 + user_id % 31 <= 15 THEN 15 - (1 + user_id % 31) ELSE greatest(0, 30 - (1 + user_id % 31)) END,
' ngày nữa tới kỳ lương"}}') AS context FROM p""")
def _(t):
    uid = F.col("user_id")
    return _profile(t).select("user_id", cx.context_json(uid % 24, 1 + uid % 31, F.col("budget_remain"), F.col("budget_total"), F.lit(None).cast("string")).alias("context"))


@query("k4_kept_groups", f"""WITH {PROFILE}, r AS (SELECT {RECORD}), k AS (SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 'Action' ELSE 'Record' END AS intent, row_id % 5 = 0 AS inc, freq > 1 AS tr, pct FROM r)
SELECT row_id, array_to_string([x for x in [CASE WHEN tr AND (intent = 'Action' OR NOT inc) THEN 'trigger' END, CASE WHEN intent = 'Action' OR NOT inc THEN 'wallet_health' END,
CASE WHEN intent = 'Record' THEN 'record_type' END, CASE WHEN intent = 'Record' AND pct > 20 THEN 'historical_fact' END, CASE WHEN intent = 'Action' AND row_id % 3 = 0 THEN 'action_facts' END,
CASE WHEN intent = 'Action' THEN 'action_type' END] if x IS NOT NULL][1:2], ',') AS groups FROM k""")
def _(t):
    rid = F.col("row_id")
    none = F.lit(None).cast("string")
    groups = cx.kept_groups(
        F.when(rid % 4 == 0, "Action").otherwise("Record"), rid % 5 == 0, F.lit("an_toan"), F.col("freq") > 1, F.lit("Expense"),
        F.when(F.col("pct") > 20, "fact"), none, F.when(rid % 3 == 0, "facts"), F.lit("SET_LIMIT"))
    return _records(t).select("row_id", groups.alias("groups"))


# --- chat ------------------------------------------------------------------------------------------
@query("w12_last_user_message", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def _(t):
    return ledger.last_user_message(t.conversations)


@query("w13_history_block", """WITH c AS (SELECT *, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN concat('BÁO CÁO ', turn) END AS action,
max(turn) OVER (PARTITION BY conv_id) AS mt, arg_max(role, turn) OVER (PARTITION BY conv_id) AS lr FROM conversations),
k AS (SELECT * FROM c WHERE lr <> 'user' OR turn < mt),
g AS (SELECT conv_id, string_agg(concat('- ', CASE role WHEN 'user' THEN 'Người dùng' ELSE 'Mascot MiMo' END, ': ', text), chr(10) ORDER BY turn) AS l, arg_max(action, turn) FILTER (action IS NOT NULL) AS a FROM k GROUP BY 1)
SELECT i.conv_id, concat_ws(chr(10) || chr(10), a, concat('LỊCH SỬ ĐỐI THOẠI GẦN ĐÂY:', chr(10), coalesce(l, ''))) AS block FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON i.conv_id = g.conv_id""")
def _(t):
    turns = t.conversations.withColumn("action", F.expr("CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN concat('BÁO CÁO ', turn) END"))
    return ledger.history_block(turns)


@query("f28_sanitise_reply")
def _(t):
    noisy = F.concat("text", F.lit(" vui vui quá 你好 .run(1) {a: 1} 😀"))
    return t.conversations.select("conv_id", "turn", tx.sanitise_reply(noisy).alias("reply"))


def _word(x: str, words: str) -> str:
    return f"regexp_matches(lower({x}), {duck.lit(r'(?:^|[^\pL\pN_\pM])(?:' + words + r')(?:[^\pL\pN_\pM]|$)')})"


@query("f31_relationship_tag", f"""SELECT conv_id, turn, CASE WHEN {_word('text', rules.PARENT_WORDS)} THEN 'PARENT' WHEN {_word('text', rules.PARTNER_WORDS)} AND {_word('text', rules.SPEND_WORDS)} THEN 'PARTNER_SPEND'
WHEN {_word('text', rules.PARTNER_WORDS)} THEN 'PARTNER' END AS tag FROM (SELECT conv_id, turn, concat(text, CASE turn % 4 WHEN 0 THEN ' mua cho vợ' WHEN 1 THEN ' mẹ' WHEN 2 THEN ' crush' ELSE '' END) AS text FROM conversations) c""")
def _(t):
    text = F.expr("concat(text, CASE turn % 4 WHEN 0 THEN ' mua cho vợ' WHEN 1 THEN ' mẹ' WHEN 2 THEN ' crush' ELSE '' END)")
    return t.conversations.select("conv_id", "turn", tx.relationship_tag(text).alias("tag"))


@query("f34_sentiment", f"""SELECT conv_id, turn, CASE WHEN {duck.contains_any('lower(text)', rules.POSITIVE_WORDS)} THEN 'Positive' WHEN {duck.contains_any('lower(text)', rules.NEGATIVE_WORDS)} THEN 'Negative' ELSE 'Neutral' END AS sentiment
FROM (SELECT conv_id, turn, concat(text, CASE turn % 3 WHEN 0 THEN ' Thanks' WHEN 1 THEN ' stress' ELSE '' END) AS text FROM conversations) c""")
def _(t):
    text = F.expr("concat(text, CASE turn % 3 WHEN 0 THEN ' Thanks' WHEN 1 THEN ' stress' ELSE '' END)")
    return t.conversations.select("conv_id", "turn", tx.sentiment(text).alias("sentiment"))


RAW = """CASE row_id % 5 WHEN 0 THEN payload WHEN 1 THEN concat('```json\\n', payload, '\\n```') WHEN 2 THEN concat('Trả lời: ', payload, ' hết') WHEN 3 THEN substr(payload, 1, length(payload) - 2) ELSE 'xin lỗi' END"""


@query("f27_parse_model_json", "SELECT row_id, CASE WHEN row_id % 5 < 4 THEN json_extract_string(payload, '$.corrected_intent') END AS intent FROM @F f")
def _(t):
    return t.F.select("row_id", F.get_json_object(payload.parse_model_json(F.expr(RAW)), "$.corrected_intent").alias("intent"))


@query("f29_payload_fields", """SELECT row_id, coalesce(intent, 'Record') AS intent, coalesce(json_extract_string(payload, '$.emotion'), 'neutral') AS emotion,
coalesce(json_extract_string(payload, '$.response'), 'Đã hiểu yêu cầu.') AS response, coalesce(json_extract_string(payload, '$.slots.category'), category) AS category FROM @F f""")
def _(t):
    return baseline.payload_fields(t.F).select("row_id", "intent", "emotion", "response", F.col("slots")["category"].alias("category"))


@query("f30_missing_slots", """SELECT row_id, array_to_string([x for x in [CASE WHEN action_type IN ('SET_LIMIT') AND coalesce(value, '') = '' THEN 'amount' END,
CASE WHEN action_type = 'SET_GOAL' AND coalesce(goal_name, '') = '' THEN 'goal_name' END, CASE WHEN action_type = 'SET_GOAL' AND coalesce(value, '') = '' THEN 'amount' END,
CASE WHEN action_type = 'SET_GOAL' AND row_id % 2 = 0 THEN 'tool_type' END, CASE WHEN action_type = 'SET_ALERT' AND coalesce(enabled, '') = '' THEN 'enabled' END,
CASE WHEN action_type = 'SET_GOAL' AND row_id % 2 = 1 THEN 'contact_name' END, CASE WHEN action_type = 'SET_GOAL' AND row_id % 2 = 1 THEN 'loan_type' END] if x IS NOT NULL], ',') AS missing FROM @A a""")
def _(t):
    tool = F.when(F.col("row_id") % 2 == 1, "loan")
    slots = {"amount": F.col("value"), "goal_name": F.col("goal_name"), "tool_type": tool, "enabled": F.col("enabled"), "theme": F.col("theme"), "verbal_style": F.col("verbal_style"), "time_range": F.col("time_range"), "query": F.col("query")}
    return t.A.select("row_id", payload.missing_slots(F.col("action_type"), slots, tool == "loan").alias("missing"))


@query("f32_money_format", """SELECT row_id, CASE WHEN amount >= 1000000 THEN CASE WHEN amount % 1000000 = 0 THEN printf('%.0ftr', amount / 1e6) ELSE printf('%.1ftr', amount / 1e6) END
ELSE CASE WHEN amount % 1000 = 0 THEN printf('%.0fk', amount / 1e3) ELSE printf('%.1fk', amount / 1e3) END END AS short, replace(format('{:,}', amount), ',', '.') AS dotted FROM (SELECT row_id, 500 * (row_id % 5000) + 500 AS amount FROM @L l) x""")
def _(t):
    amount = 500 * (F.col("row_id") % 5000) + 500
    return t.L.select("row_id", money.compact_money(amount).alias("short"), money.dotted_thousands(amount).alias("dotted"))


@query("f35_emotion", """SELECT row_id, CASE WHEN intent = 'Chitchat' THEN 'Happy' WHEN intent = 'Record' AND amt > 5000000 THEN 'Sad' WHEN intent = 'Record' AND label IN ('Entertainment', 'Shopping') THEN 'Happy'
WHEN intent = 'Action' AND (contains(label, 'LIMIT') OR contains(label, 'ALERT')) THEN 'Alert' ELSE 'Chill' END AS emotion FROM (SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'Record' WHEN 1 THEN 'Action' ELSE 'Chitchat' END AS intent,
CASE WHEN row_id % 5 = 1 THEN 'SET_LIMIT' ELSE label END AS label, row_id * 1000 AS amt FROM @U u) x""")
def _(t):
    intent = F.expr("CASE row_id % 3 WHEN 0 THEN 'Record' WHEN 1 THEN 'Action' ELSE 'Chitchat' END")
    label = F.expr("CASE WHEN row_id % 5 = 1 THEN 'SET_LIMIT' ELSE label END")
    return t.U.select("row_id", tx.emotion(intent, label, F.col("row_id") * 1000).alias("emotion"))


@query("f36_asset_name", """SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'Happy' WHEN 1 THEN 'Taunting' WHEN 2 THEN 'Chill' END AS asset FROM @F f""")
def _(t):
    return t.F.select("row_id", tx.asset_name(F.expr("CASE row_id % 4 WHEN 0 THEN 'vui' WHEN 1 THEN 'cham_choc' WHEN 2 THEN ' CHILL' ELSE 'nope' END")).alias("asset"))


@query("f38_money_text")
def _(t):
    return t.L.select("row_id", money.money_text(F.col("row_id")).alias("long"), money.money_text_short(F.col("row_id")).alias("short"))


@query("f41_log_lines", r"""SELECT doc_id, x AS line FROM (SELECT doc_id, unnest(list_transform(string_split_regex(text, '\r\n|\n|\r'),
lambda s: regexp_replace(regexp_replace(trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(160)), '^[0-9]+[.)]\s*', ''), '^[-•* ]+|[-•* ]+$', '', 'g'))) AS x FROM documents) d WHERE length(x) >= 4 AND regexp_matches(x, '[0-9]')""")
def _(t):
    return t.documents.select("doc_id", F.explode(tx.log_lines(F.col("text"))).alias("line"))


@query("f46_fallbacks", f"""SELECT row_id, CASE WHEN json_extract_string(payload, '$.slots.type') = 'income' THEN 'Income' ELSE 'Expense' END AS record_type,
CASE WHEN intent = 'Action' THEN CASE WHEN row_id % 2 = 0 THEN 'SET_LIMIT' WHEN row_id % 3 = 0 THEN 'REPORT_GENERAL' ELSE 'SEARCH_RECORD' END END AS action_type FROM @F f""")
def _(t):
    rows = t.F.withColumn("p", F.from_json("payload", payload.PAYLOAD))
    text = F.expr("CASE WHEN row_id % 3 = 0 THEN 'Xem Báo cáo' ELSE text_input END")
    action = F.expr("CASE WHEN row_id % 2 = 0 THEN 'SET_LIMIT' END")
    return rows.select("row_id", payload.fallback_record_type(F.col("p.record_type"), F.col("p.slots")["type"]).alias("record_type"),
                       payload.fallback_action(F.col("intent"), action, text).alias("action_type"))


@query("f47_merge_forced", """SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'cat_forced' ELSE json_extract_string(payload, '$.slots.category') END AS category, '0' AS amount,
CASE WHEN intent = 'Record' THEN CASE WHEN row_id % 4 = 0 THEN 'Income' ELSE 'Expense' END END AS record_type, 'gao' AS item,
coalesce(json_extract_string(payload, '$.emotion'), 'neutral') AS emotion, text_input AS text, CASE WHEN intent = 'Chitchat' THEN 'Ghi chép|Quét bill|Xem báo cáo' END AS suggested_actions FROM @F f""")
def _(t):
    rows = t.F.withColumn("p", F.from_json("payload", payload.PAYLOAD))
    forced = F.expr("CASE WHEN row_id % 3 = 0 THEN 'cat_forced' END")
    kind = F.expr("CASE WHEN row_id % 4 = 0 THEN 'Income' END")
    return rows.select("row_id", *payload.merge_forced(F.col("p"), F.col("text_input"), forced, kind, F.col("intent")))


# --- rule baseline ---------------------------------------------------------------------------------
NORM = duck.fold_marks("text")
BASE_CAT = {c: "(" + " + ".join(f"CASE WHEN contains({NORM}, {duck.lit(baseline.folded(w))}) THEN 1 ELSE 0 END" for w in words) + ")" for c, words in rules.BASELINE_KEYWORDS.items()}


def _base_category() -> str:
    sums = ", ".join(f"{e} AS s{i}" for i, e in enumerate(BASE_CAT.values()))
    n = len(BASE_CAT)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    return sums, best, "CASE WHEN " + best + " = 0 THEN 'Others' " + " ".join(f"WHEN s{i} = {best} THEN {duck.lit(c)}" for i, c in enumerate(BASE_CAT)) + " END"


_SUMS, _BEST, _CATEGORY = _base_category()
BASE_MONEY = duck.lit(r"(?i)([0-9]+(?:[.,][0-9]+)?)\s?(k|đ|d|vnđ|vnd|ngan|nghìn|nghin|triệu|trieu|củ|cu|tr)?")
BASELINE = f"""b AS (SELECT row_id, text, {NORM} AS norm, {_SUMS}, regexp_extract_all(text, {BASE_MONEY}, 1) AS n, [lower(x) for x in regexp_extract_all(text, {BASE_MONEY}, 2)] AS v FROM @U u),
m AS (SELECT *, [x for x in [CAST(replace(n[i], ',', '.') AS DOUBLE) * list_extract([CASE WHEN u IN ('k', 'nghin', 'nghìn', 'ngan') THEN 1000 WHEN u IN ('triệu', 'trieu', 'củ', 'cu', 'tr') THEN 1000000 ELSE 1 END for u in v], i) for i in range(1, len(n) + 1)] if x >= 1000] AS am FROM b),
k AS (SELECT *, {duck.contains_any('norm', [baseline.folded(w) for w in rules.BASELINE_ACTION])} AS act, {duck.contains_any('norm', [baseline.folded(w) for w in rules.BASELINE_INCOME])} AS inc FROM m)"""


@query("m8_rule_baseline", f"""WITH {BASELINE}, z AS (SELECT *, CASE WHEN act THEN 'Action' WHEN len(am) > 0 THEN 'Record' ELSE 'Chitchat' END AS intent FROM k)
SELECT row_id, intent, CASE WHEN act THEN 0.7 WHEN len(am) > 0 THEN 0.85 WHEN len(string_split(trim(regexp_replace(norm, '\\s+', ' ', 'g')), ' ')) <= 5 THEN 0.6 ELSE 0.5 END AS confidence, CAST(am[1] AS DOUBLE) AS amount,
CASE WHEN intent = 'Record' THEN {_CATEGORY} END AS category, CASE WHEN intent = 'Record' THEN CASE WHEN inc THEN 'Income' ELSE 'Expense' END END AS record_type FROM z""")
def _(t):
    return baseline.rule_baseline(t.U).select("row_id", "intent", "confidence", "amount", "category", "record_type")


@query("m10_longest_span", """SELECT row_id, arg_max(w, length(w) * 1000 + i) AS item FROM (SELECT row_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM @U u) x
WHERE w <> '' GROUP BY 1""")
def _(t):
    return t.U.select("row_id", baseline.longest_span(F.split("text", " ")).alias("item")).filter("item IS NOT NULL")


@query("r15_plain_receipt", f"""WITH r AS (SELECT receipt_id AS row_id, string_agg(text, chr(10) ORDER BY y1, x1, box_id) AS text FROM @R r GROUP BY 1), {BASELINE.replace('FROM @U u', 'FROM r')}
SELECT row_id, len([x for x in string_split(text, chr(10)) if trim(x) <> '']) AS lines, list_max(am) AS amount, {_CATEGORY} AS category FROM k""")
def _(t):
    parts = F.array_sort(F.collect_list(F.struct("y1", "x1", "box_id", "text")))
    texts = t.R.groupBy(F.col("receipt_id").alias("row_id")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return baseline.plain_receipts(texts)


J6_LOG = """concat(text_input, CASE row_id % 7 WHEN 0 THEN ' hoàng kim thượng hạng' WHEN 1 THEN ' ở chợ' WHEN 2 THEN ' ngon ở chợ đầu mối' WHEN 3 THEN ' nếp'
WHEN 4 THEN concat(' lô ', row_id % 40) ELSE '' END) AS text"""
J6_FIX = """lower(concat(text_input, CASE row_id % 5 WHEN 0 THEN ' ngon ở chợ' WHEN 1 THEN ' ở chợ đầu mối' WHEN 2 THEN concat(' lô ', row_id % 40) WHEN 3 THEN ' hoàng kim' ELSE '' END)) AS text"""


def _words(x: str) -> str:
    kept = f"trim(regexp_replace(regexp_replace(lower({duck.clean_category(x)}), '[^\\pL\\pM\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"[w for w in string_split({kept}, ' ') if w <> '']"


_J6_GRAMS = "list_concat(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]), [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)])"


@query("j6_similar_correction", f"""WITH l AS (SELECT row_id, user_id, lower({duck.clean_category('text')}) AS clean, {_words('text')} AS t FROM (SELECT row_id, user_id, {J6_LOG} FROM @F f) z),
r AS (SELECT row_id AS correction_id, user_id, lower(trim(text)) AS clean, {_words('text')} AS t FROM (SELECT row_id, user_id, {J6_FIX} FROM @F f WHERE log_type = 'dislike') z),
n AS (SELECT count(*) AS n FROM @U u), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_J6_GRAMS})) AS term FROM (SELECT {_words('text')} AS t FROM @U u) z) y GROUP BY term),
d AS (SELECT t FROM l UNION SELECT t FROM r), g AS (SELECT t, term, count(*) AS tf FROM (SELECT t, unnest({_J6_GRAMS}) AS term FROM d) z GROUP BY t, term),
w AS (SELECT t, g.term, tf * (ln((1.0 + n.n) / (1.0 + coalesce(df, 0))) + 1.0) AS x FROM g CROSS JOIN n LEFT JOIN df USING (term)),
v AS (SELECT t, term, x / sqrt(sum(x * x) OVER (PARTITION BY t)) AS x FROM w),
e AS (SELECT l.row_id, min(correction_id) AS correction_id FROM l JOIN r ON l.user_id = r.user_id AND l.clean = r.clean WHERE l.clean <> '' GROUP BY 1),
p AS (SELECT DISTINCT l.t AS a, r.t AS b FROM l JOIN r ON l.user_id = r.user_id),
s AS (SELECT a, b, round(sum(v.x * u.x), 9) AS score FROM p JOIN v ON v.t = a JOIN v AS u ON u.t = b AND u.term = v.term GROUP BY a, b HAVING round(sum(v.x * u.x), 9) >= 0.85),
m AS (SELECT l.row_id, r.correction_id, score FROM l JOIN r ON l.user_id = r.user_id JOIN s ON s.a = l.t AND s.b = r.t WHERE l.row_id NOT IN (SELECT row_id FROM e)
QUALIFY row_number() OVER (PARTITION BY l.row_id ORDER BY score DESC, r.correction_id) = 1)
SELECT row_id, correction_id, 'exact' AS match_type, 1.0 AS score FROM e UNION ALL SELECT row_id, correction_id, 'similarity', round(score, 6) FROM m""")
def _(t):
    fixes = t.F.filter("log_type = 'dislike'").selectExpr("row_id AS correction_id", "user_id", J6_FIX)
    weights = similarity.gram_weights(t.U, F.col("text"))
    found = similarity.similar_corrections(t.F.selectExpr("row_id", "user_id", J6_LOG), fixes, weights)
    return found.withColumn("score", F.round("score", 6))
