"""Queries over the corpus tables: P1-P26, D1-D14, J1-J5, J15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import text as tx
from tallyspark.operators import curate, dedupe
from tallyspark.plans import duck
from tallyspark.plans.registry import query

U4 = "row_id, text, label, type, is_money"
OVERRIDE = {"báo cáo": "Report", "tìm khoản": "Search"}


@query("p1_conform", "SELECT " + ", ".join(
    c if c not in ("note",) else "CAST(NULL AS VARCHAR) AS note" for c in rules.ACTION_COLUMNS) + " FROM @A a")
def _(t):
    return curate.conform(t.A, rules.ACTION_COLUMNS)


@query("p2_require", f"SELECT {U4} FROM @U u WHERE text IS NOT NULL AND label IS NOT NULL")
def _(t):
    return curate.require(t.U, ["text", "label"])


@query("p3_keep_types", f"SELECT {U4} FROM @U u WHERE type IN ('expense', 'income')")
def _(t):
    return curate.keep_types(t.U, rules.RECORD_TYPES)


@query("p4_remap", "SELECT row_id, CASE label WHEN 'Saving' THEN 'Savings' ELSE label END AS label FROM @U u")
def _(t):
    return curate.remap(t.U, "label", {"Saving": "Savings"}).select("row_id", "label")


NORMALISED = ("CASE WHEN action_type = 'Edit' THEN CASE WHEN " + duck.contains_any("lower(text)", rules.DELETE_WORDS)
              + " THEN 'DELETE_RECORD' ELSE 'UPDATE_RECORD' END ELSE "
              + duck.case_map("action_type", rules.ACTION_ALIASES, "action_type") + " END")


@query("p5_normalise_action", f"SELECT row_id, {NORMALISED} AS action_type FROM @A a")
def _(t):
    return curate.normalise_action(t.A).select("row_id", "action_type")


@query("p6_drop_labels", f"""SELECT row_id, action_type FROM (SELECT row_id, {NORMALISED} AS action_type FROM @A a) x
WHERE action_type NOT IN {duck.in_list(rules.RETIRED_ACTIONS)}""")
def _(t):
    return curate.drop_labels(curate.normalise_action(t.A), rules.RETIRED_ACTIONS).select("row_id", "action_type")


@query("p6_dropped_count", f"""SELECT count(*) AS rows_before,
count(*) FILTER (action_type IN {duck.in_list(rules.RETIRED_ACTIONS)}) AS dropped
FROM (SELECT {NORMALISED} AS action_type FROM @A a) x""")
def _(t):
    return curate.dropped_count(curate.normalise_action(t.A), rules.RETIRED_ACTIONS)


@query("p7_drop_polluted", f"""SELECT row_id, text, action_type FROM (SELECT row_id, text, {NORMALISED} AS action_type
FROM @A a) x WHERE NOT (action_type = 'REPORT_GENERAL' AND {duck.has_money('lower(text)')})""")
def _(t):
    return curate.drop_polluted(curate.normalise_action(t.A)).select("row_id", "text", "action_type")


@query("p8_relabel_if", f"""SELECT row_id, CASE WHEN action_type = 'SYSTEM_SETTING'
AND {duck.rx('text', rules.ALERT_TEXT)} THEN 'SET_ALERT' ELSE action_type END AS action_type
FROM (SELECT row_id, text, {NORMALISED} AS action_type FROM @A a) x""")
def _(t):
    return curate.relabel_if(curate.normalise_action(t.A), "action_type", "SYSTEM_SETTING", "SET_ALERT",
                             rules.ALERT_TEXT).select("row_id", "action_type")


@query("p9_relabel_two_sets", f"""SELECT row_id, CASE WHEN action_type = 'REPORT_GENERAL'
AND {duck.contains_any('lower(trim(text))', rules.SUGGEST_PHRASES)}
AND {duck.contains_any('lower(trim(text))', rules.SUGGEST_TOPICS)} THEN 'SUGGEST_BUDGET' ELSE action_type END
AS action_type FROM @A a""")
def _(t):
    return curate.relabel_two_sets(t.A, "action_type", "REPORT_GENERAL", "SUGGEST_BUDGET", rules.SUGGEST_PHRASES,
                                   rules.SUGGEST_TOPICS).select("row_id", "action_type")


@query("p10_drop_matching", r"""SELECT row_id, text FROM @U u
WHERE NOT ((regexp_matches(text, '(?i)xuất(?:[^\pL\pN_]|$)') AND NOT regexp_matches(text, '(?i)xuất đề'))
           OR regexp_matches(text, '(?i)export(?:[^\pL\pN_]|$)'))""")
def _(t):
    return curate.drop_matching(t.U, curate.EXPORT_VERB).select("row_id", "text")


@query("p11_kept", f"SELECT {U4} FROM @U u WHERE NOT {duck.ACTION_LIKE}")
def _(t):
    return curate.split_action_like(t.U)[0]


@query("p11_removed", f"SELECT {U4} FROM @U u WHERE {duck.ACTION_LIKE}")
def _(t):
    return curate.split_action_like(t.U)[1]


@query("p12_fix_type_label",
       f"SELECT row_id, {duck.TYPE_FIXED} AS type, {duck.LABEL_FIXED} AS label FROM @U u")
def _(t):
    return curate.fix_type_label(t.U).select("row_id", "type", "label")


@query("p13_category_hint", f"SELECT row_id, {duck.hint('text')} AS hint FROM @U u")
def _(t):
    return t.U.select("row_id", curate.category_hint(F.col("text")).alias("hint"))


HINTED = f"""SELECT row_id, text, type, CASE WHEN hint IS NOT NULL AND lower(type) = 'expense'
AND label IS DISTINCT FROM hint THEN hint ELSE label END AS label"""


@query("p14_apply_hint", f"{HINTED} FROM (SELECT *, {duck.hint('text')} AS hint FROM @U u) x")
def _(t):
    return curate.apply_hint(t.U).select("row_id", "text", "type", "label")


@query("p14_fix_chain", f"""WITH a AS (SELECT row_id, text, {duck.TYPE_FIXED} AS type, {duck.LABEL_FIXED} AS label
FROM @U u WHERE NOT {duck.ACTION_LIKE}),
b AS (SELECT row_id, text, CASE WHEN {duck.family_gift('text')} THEN 'income' ELSE type END AS type,
CASE WHEN {duck.family_gift('text')} THEN 'Bonus' ELSE label END AS label FROM a)
{HINTED} FROM (SELECT *, {duck.hint('text')} AS hint FROM b) x""")
def _(t):
    return curate.fix_disambiguation(t.U).select("row_id", "text", "type", "label")


@query("p15_family_gift", f"SELECT row_id, text FROM @U u WHERE {duck.family_gift('text')}")
def _(t):
    return t.U.filter(curate.is_family_gift(F.col("text"))).select("row_id", "text")


@query("p15_fix_family_gift", f"""SELECT row_id, CASE WHEN lower(type) = 'income' AND is_money = 1
AND label = 'Business' AND {duck.family_gift('text')} THEN 'Bonus' ELSE label END AS label FROM @U u""")
def _(t):
    return curate.fix_family_gift(t.U).select("row_id", "label")


@query("p16_override_exact", """WITH o AS (SELECT text, min(action_type) || '_FIXED' AS label FROM @A a
WHERE row_id % 5 = 0 GROUP BY text)
SELECT a.row_id, coalesce(o.label, a.action_type) AS action_type FROM @A a LEFT JOIN o ON trim(a.text) = o.text""")
def _(t):
    fixes = t.A.filter("row_id % 5 = 0").groupBy("text").agg(
        F.concat(F.min("action_type"), F.lit("_FIXED")).alias("label"))
    return curate.override_exact(t.A, fixes, "action_type").select("row_id", "action_type")


@query("p17_validate_record", f"""SELECT row_id, text, CASE label WHEN 'Saving' THEN 'Savings' ELSE label END AS label,
type, CASE WHEN is_money IN (0, 1) THEN is_money ELSE 1 END AS is_money,
CASE WHEN length(text) < 2 THEN 'short_text'
     WHEN coalesce(label NOT IN {duck.in_list(rules.CATEGORIES + ['Saving'])}, true) THEN 'bad_label'
     WHEN type NOT IN ('expense', 'income') THEN 'bad_type' END AS reason
FROM (SELECT row_id, {duck.strip_hash('text')} AS text, label, type, is_money FROM @U u) x""")
def _(t):
    return curate.validate_record(t.U)


def _slot(name, check=None):
    ok = f"list_contains(allowed, '{name}') AND {name} <> ''" + (f" AND {check}" if check else "")
    if name == "value":
        return (f"CASE WHEN {ok} THEN CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(value AS "
                "DOUBLE)) THEN CAST(CAST(try_cast(value AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(value) END END AS value")
    return f"CASE WHEN {ok} THEN trim({name}) END AS {name}"


_ALLOWED = ("CASE action_type " + " ".join(
    f"WHEN '{a}' THEN [{', '.join(duck.lit(s) for s in ss)}]" for a, ss in rules.SLOTS_BY_ACTION.items()) + " ELSE [] END")
_SLOTS = [c for c in rules.SLOT_COLUMNS if c != "note"]
_CHECKS = {"verb": f"upper(verb) IN {duck.in_list(rules.VERBS)}",
           "category_code": f"category_code IN {duck.in_list(rules.CATEGORIES)}",
           "theme": "lower(theme) IN ('dark', 'light')",
           "verbal_style": f"lower(verbal_style) IN {duck.in_list(rules.VERBAL_STYLES)}"}
_NEEDED = [c for c in _SLOTS if c != "category_code"]


@query("p18_validate_slots", f"""WITH n AS (SELECT * REPLACE ({NORMALISED} AS action_type) FROM @A a),
w AS (SELECT *, {_ALLOWED} AS allowed FROM n),
s AS (SELECT row_id, trim(text) AS text, action_type, allowed, {', '.join(_slot(c, _CHECKS.get(c)) for c in _SLOTS)} FROM w),
m AS (SELECT *, [x for x in [{', '.join(f"CASE WHEN list_contains(allowed, '{c}') AND coalesce({c}, '') = '' THEN '{c}' END" for c in _NEEDED)}]
     if x IS NOT NULL] AS missing FROM s)
SELECT row_id, text, action_type, {', '.join(_SLOTS)},
CASE WHEN length(text) < 4 OR length(text) > 200 THEN 'bad_length'
     WHEN len(missing) > 0 THEN 'missing:' || array_to_string(missing, ',') END AS reason FROM m""")
def _(t):
    return curate.validate_slots(curate.normalise_action(t.A))


PIPE_LINE = """concat(CASE WHEN row_id % 11 = 0 THEN '# ' ELSE '' END, text, ' | ',
CASE WHEN row_id % 7 = 1 THEN 'Foo' ELSE coalesce(label, 'Others') END, ' | ', type, ' | ',
CASE WHEN row_id % 5 = 1 THEN 'x' ELSE CAST(is_money AS VARCHAR) END)"""


@query("p19_parse_pipe", f"""WITH e AS (SELECT text FROM @U u WHERE row_id % 3 = 0),
l AS (SELECT row_id, string_split({PIPE_LINE}, '|') AS p FROM @U u WHERE row_id % 3 <> 0 AND row_id % 11 <> 0),
g AS (SELECT row_id, {duck.ws('p[1]')} AS text, trim(p[2]) AS label, trim(p[3]) AS type,
      try_cast(trim(p[4]) AS INT) AS is_money FROM l),
ok AS (SELECT * FROM g WHERE label IN {duck.in_list(rules.CATEGORIES)} AND type IN ('expense', 'income')
       AND is_money IN (0, 1) AND length(text) BETWEEN 1 AND 120
       AND NOT (type = 'income' AND regexp_matches(text, '(?i)^(?:mua|chi|order|thanh toán|trả|đóng)(?: |$)'))),
f AS (SELECT * FROM ok WHERE text NOT IN (SELECT trim(text) FROM e)
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1)
SELECT * FROM f WHERE {duck.mask('text')} NOT IN (SELECT {duck.mask('text')} FROM e)
QUALIFY row_number() OVER (PARTITION BY {duck.mask('text')} ORDER BY row_id) = 1""")
def _(t):
    lines = t.U.filter("row_id % 3 <> 0").select(
        "row_id", F.expr(PIPE_LINE.replace("VARCHAR", "STRING")).alias("line"))
    return curate.parse_pipe(lines, t.U.filter("row_id % 3 = 0").select("text"))


INDEX_LINE = "concat(row_id, ' | \"', upper(text), '\" | x | y | 1')"


@query("p20_merge_by_index", f"""SELECT u.row_id, u.label, substr(trim(coalesce(l.c, u.text)), 1, 72) AS text FROM @U u
LEFT JOIN (SELECT row_id, upper(text) AS c FROM @U v WHERE row_id % 4 = 0) l ON u.row_id = l.row_id""")
def _(t):
    lines = t.U.filter("row_id % 4 = 0").select(F.col("row_id").alias("line_no"), F.expr(INDEX_LINE).alias("line"))
    return curate.merge_by_index(t.U.select("row_id", "text", "label"), lines)


FLAT = f"""SELECT row_id, intent AS expected_intent, coalesce(category_code, 'None') AS expected_category,
CASE WHEN row_id % 13 = 0 THEN 'income' ELSE 'None' END AS expected_record_type,
CASE WHEN row_id % 17 = 0 THEN 'None' ELSE action_type END AS expected_action_type"""


@query("p21_flat_violations", f"""WITH f AS ({FLAT} FROM (SELECT * REPLACE ({NORMALISED} AS action_type) FROM @A a) n)
SELECT row_id, v AS violation FROM (SELECT row_id, unnest([x for x in [
CASE WHEN expected_intent NOT IN ('Record', 'Action', 'Chitchat') THEN 'bad_intent' END,
CASE WHEN expected_intent = 'Action' AND expected_action_type NOT IN {duck.in_list(rules.BENCHMARK_ACTIONS)} THEN 'bad_action' END,
CASE WHEN expected_intent = 'Action' AND expected_record_type <> 'None' THEN 'action_with_record_type' END,
CASE WHEN expected_intent = 'Action' AND expected_action_type IN {duck.in_list(rules.NO_CATEGORY_ACTIONS)}
     AND expected_category <> 'None' THEN 'action_with_category' END] if x IS NOT NULL]) AS v FROM f) z""")
def _(t):
    flat = curate.normalise_action(t.A).selectExpr(*[
        "row_id", "intent AS expected_intent", "coalesce(category_code, 'None') AS expected_category",
        "CASE WHEN row_id % 13 = 0 THEN 'income' ELSE 'None' END AS expected_record_type",
        "CASE WHEN row_id % 17 = 0 THEN 'None' ELSE action_type END AS expected_action_type"])
    return curate.flat_violations(flat)


@query("p22_slot_not_in_text", """SELECT row_id, goal_name FROM @A a WHERE goal_name <> ''
AND len([w for w in string_split(lower(goal_name), ' ') if contains(lower(text), w)]) = 0""")
def _(t):
    return curate.slot_not_in_text(t.A).select("row_id", "goal_name")


@query("p23_slot_coverage", f"""SELECT count(*) AS rows, count(*) FILTER (n > 0) AS labelled_rows,
CAST(sum(n) AS BIGINT) AS labelled_cells FROM (SELECT {' + '.join(
    f"CASE WHEN {duck.blank(c)} IS NULL THEN 0 ELSE 1 END" for c in _SLOTS)} AS n FROM @A a) x""")
def _(t):
    return curate.slot_coverage(t.A, _SLOTS)


@query("p24_replace_block", """SELECT row_id, text FROM @U u WHERE row_id < 1000 OR row_id >= 2000
UNION ALL SELECT row_id, concat('dòng ', row_id) AS text FROM @U u WHERE row_id >= 1000 AND row_id < 2000""")
def _(t):
    block = t.U.filter("row_id >= 1000 AND row_id < 2000").select(
        "row_id", F.concat(F.lit("dòng "), F.col("row_id")).alias("text"))
    return curate.replace_block(t.U.select("row_id", "text"), 1000, 2000, block)


@query("p25_shorten")
def _(t):
    story = F.concat(
        F.element_at(F.array(*map(F.lit, ["Story time 7: ", "Case văn phòng: ", "Nay có khoản về từ ", "mua đồ "])),
                     (F.col("row_id") % 4 + 1).cast("int")),
        F.col("text"), F.lit(" ở food court, tổng "), F.col("row_id") % 90, F.lit("k, thanh toán bằng quẹt thẻ"))
    return t.U.select("row_id", curate.shorten(story, F.coalesce("label", F.lit("Others")), F.col("type")).alias("text"))


@query("p26_canon_intent", f"""SELECT row_id, {duck.canon_intent('raw')} AS intent,
{duck.case_map("lower(trim(kind))", rules.TYPE_ALIASES, 'kind')} AS record_type
FROM (SELECT row_id, json_extract_string(payload, '$.corrected_intent') AS raw,
      CASE row_id % 3 WHEN 0 THEN 'chi' WHEN 1 THEN ' Income' ELSE 'other' END AS kind FROM @F f) x""")
def _(t):
    raw = F.get_json_object("payload", "$.corrected_intent")
    kind = F.expr("CASE row_id % 3 WHEN 0 THEN 'chi' WHEN 1 THEN ' Income' ELSE 'other' END")
    return t.F.select("row_id", curate.canon_intent(raw).alias("intent"), curate.canon_type(kind).alias("record_type"))


# --- deduplication ---------------------------------------------------------------------------------
@query("d1_dedupe_exact", """SELECT doc_id AS row_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("row_id"), "text", "n_chars")
    return dedupe.dedupe_exact(docs).select("row_id", "n_chars")


@query("d2_dedupe_masked", f"""WITH e AS (SELECT row_id, text FROM @U u
QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1)
SELECT row_id, text FROM e QUALIFY row_number() OVER (PARTITION BY {duck.mask('text')} ORDER BY row_id) = 1""")
def _(t):
    return dedupe.dedupe_masked(t.U.select("row_id", "text"))


@query("d3_dedupe_folded", f"""SELECT doc_id AS row_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY {duck.ws(duck.fold_marks('text'))} ORDER BY doc_id) = 1""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("row_id"), "text", "source")
    return dedupe.dedupe_folded(docs).select("row_id", "source")


@query("d4_dedupe_ci", f"""SELECT doc_id AS row_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lower({duck.strip('text')}) ORDER BY doc_id) = 1""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("row_id"), "text", "lang")
    return dedupe.dedupe_ci(docs).select("row_id", "lang")


@query("d5_dedupe_mode", """WITH f AS (SELECT * FROM @F f),
h AS (SELECT text_input, arg_min(intent, row_id) FILTER (intent IS NOT NULL) AS intent FROM f GROUP BY 1),
c AS (SELECT text_input, category, row_number() OVER (PARTITION BY text_input ORDER BY count(*) DESC, category) AS rn
      FROM f WHERE category IS NOT NULL GROUP BY 1, 2),
l AS (SELECT text_input, log_type, row_number() OVER (PARTITION BY text_input ORDER BY count(*) DESC, log_type) AS rn
      FROM f GROUP BY 1, 2)
SELECT h.text_input, h.intent, c.category, l.log_type FROM h
LEFT JOIN c ON h.text_input = c.text_input AND c.rn = 1 LEFT JOIN l ON h.text_input = l.text_input AND l.rn = 1""")
def _(t):
    return dedupe.dedupe_mode(t.F, "text_input", "intent", ["category", "log_type"])


@query("d6_dedupe_spans", """SELECT row_id, text FROM @U u
QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY row_id) = 1""")
def _(t):
    return dedupe.dedupe_spans(t.U.select("row_id", "text"))


@query("d7_upsert", """WITH b AS (SELECT row_id, text_input, intent, 1 AS p FROM @F f WHERE row_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY text_input ORDER BY row_id) = 1),
n AS (SELECT row_id, text_input, 'new' AS intent, 0 AS p FROM @F f WHERE row_id % 3 = 0)
SELECT row_id, text_input, intent FROM (SELECT * FROM b UNION ALL SELECT * FROM n) x
QUALIFY row_number() OVER (PARTITION BY text_input ORDER BY p, row_id DESC) = 1""")
def _(t):
    f = t.F.select("row_id", "text_input", "intent")
    base = dedupe.dedupe_exact(f.filter("row_id % 2 = 0"), "text_input")
    return dedupe.upsert(base, f.filter("row_id % 3 = 0").withColumn("intent", F.lit("new")), "text_input")


@query("d8_upsert_keep", """WITH f AS (SELECT row_id, text_input, category FROM @F f),
b AS (SELECT * FROM f WHERE row_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY text_input ORDER BY row_id) = 1),
n AS (SELECT row_id, text_input, 'spans' AS category FROM f WHERE row_id % 3 = 0
      QUALIFY row_number() OVER (PARTITION BY text_input ORDER BY row_id) = 1)
SELECT coalesce(b.text_input, n.text_input) AS text_input,
       CASE WHEN coalesce(b.category, '') <> '' THEN b.category ELSE n.category END AS category
FROM b FULL JOIN n ON b.text_input = n.text_input""")
def _(t):
    f = t.F.select("row_id", "text_input", "category")
    base = dedupe.dedupe_exact(f.filter("row_id % 2 = 0"), "text_input")
    return dedupe.upsert_keep(base, f.filter("row_id % 3 = 0").withColumn("category", F.lit("spans")), "text_input",
                              "category")


@query("d9_union_tagged", """SELECT row_id, text, 'Record' AS intent FROM @U u
UNION ALL SELECT row_id, text, 'Action' FROM @A a UNION ALL SELECT row_id, text_input, 'Chitchat' FROM @F f""")
def _(t):
    chat = t.F.select("row_id", F.col("text_input").alias("text"))
    return dedupe.union_tagged({"Record": t.U, "Action": t.A, "Chitchat": chat}, "intent", ["row_id", "text"])


@query("d10_add_increment", """SELECT receipt_id, box_id, text, CAST(NULL AS VARCHAR) AS entity FROM @R r
UNION ALL SELECT receipt_id, box_id, text, 'TOTAL_COST' FROM @R r WHERE box_id = 1001""")
def _(t):
    boxes = t.R.select("receipt_id", "box_id", "text")
    return dedupe.add_increment(boxes, boxes.filter("box_id = 1001").withColumn("entity", F.lit("TOTAL_COST")))


@query("d11_route", f"""SELECT row_id, trim(text) AS text, 'Action' AS intent, 'REPORT_GENERAL' AS action_type
FROM @U u WHERE {duck.ACTION_LIKE} AND trim(text) NOT IN (SELECT trim(text) FROM @A a)
QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY row_id) = 1""")
def _(t):
    return dedupe.route(t.U, t.A)


@query("d12_label_universe", "SELECT label_true AS label FROM @Y y UNION SELECT label_pred FROM @Y y")
def _(t):
    return dedupe.label_universe(t.Y)


@query("d13_minus", """SELECT row_id, text FROM @U u
WHERE text NOT IN (SELECT text FROM @U v WHERE type = 'income')""")
def _(t):
    return dedupe.minus(t.U.select("row_id", "text"), t.U.filter("type = 'income'"))


@query("d14_set_status", """SELECT row_id AS run_index, CASE WHEN row_id % 10 = 3 THEN 'rejected'
WHEN log_type = 'chat' THEN 'success' ELSE 'failed' END AS status FROM @F f""")
def _(t):
    history = t.F.selectExpr("row_id AS run_index", "CASE WHEN log_type = 'chat' THEN 'success' ELSE 'failed' END AS status")
    changes = history.filter("run_index % 10 = 3").withColumn("status", F.lit("rejected"))
    return dedupe.set_status(history, changes)


# --- joins -----------------------------------------------------------------------------------------
@query("j1_append_new", f"""SELECT {U4} FROM @U u WHERE row_id % 2 = 1
AND trim(text) NOT IN (SELECT trim(text) FROM @U v WHERE row_id % 2 = 0)
QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY row_id) = 1""")
def _(t):
    return dedupe.append_new(t.U.filter("row_id % 2 = 0"), t.U.filter("row_id % 2 = 1"))


@query("j2_append_new_masked", f"""WITH e AS (SELECT text FROM @U u WHERE row_id % 5 = 0),
f AS (SELECT row_id, text FROM @U u WHERE row_id % 5 <> 0 AND trim(text) NOT IN (SELECT trim(text) FROM e)
      QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY row_id) = 1)
SELECT row_id, text FROM f WHERE {duck.mask('text')} NOT IN (SELECT {duck.mask('text')} FROM e)
QUALIFY row_number() OVER (PARTITION BY {duck.mask('text')} ORDER BY row_id) = 1""")
def _(t):
    u = t.U.select("row_id", "text")
    return dedupe.append_new_masked(u.filter("row_id % 5 = 0"), u.filter("row_id % 5 <> 0"))


@query("j3_rewrite_by_position", """WITH p AS (SELECT row_id, trim(text) AS o, trim(replace(text, 'mua', 'chi')) AS n
FROM @U u WHERE row_id % 6 = 0),
m AS (SELECT o, n FROM p WHERE o <> n QUALIFY row_number() OVER (PARTITION BY o ORDER BY row_id DESC) = 1)
SELECT u.row_id, coalesce(m.n, u.text) AS text FROM @U u LEFT JOIN m ON trim(u.text) = m.o""")
def _(t):
    old = t.U.filter("row_id % 6 = 0").select("row_id", "text")
    new = old.withColumn("text", F.expr("replace(text, 'mua', 'chi')"))
    return dedupe.rewrite_by_position(t.U.select("row_id", "text"), old, new)


CORPUS_SQL = """SELECT row_id, concat('mua gạo ', row_id % 200, 'k') AS text,
CASE row_id % 3 WHEN 0 THEN 'Record' WHEN 1 THEN 'Action' ELSE 'Chitchat' END AS intent,
CASE WHEN row_id % 4 = 0 THEN 'cat_old' END AS category_code FROM"""


@query("j4_merge_feedback", f"""WITH c AS (SELECT *, min(CASE intent WHEN 'Record' THEN 1 WHEN 'Action' THEN 2 ELSE 3 END) OVER (PARTITION BY lower(trim(text))) AS place
      FROM ({CORPUS_SQL} @A a) y),
d AS (SELECT *, lower(trim(text_input)) AS k FROM @F f WHERE log_type = 'dislike'
      QUALIFY row_number() OVER (PARTITION BY lower(trim(text_input)) ORDER BY row_id) = 1),
x AS (SELECT k, text_input, {duck.canon_intent("json_extract_string(payload, '$.corrected_intent')")} AS ni,
      CASE WHEN json_extract_string(payload, '$.corrected_category') LIKE 'cat\\_%' ESCAPE '\\'
           THEN json_extract_string(payload, '$.corrected_category') END AS nc
      FROM d WHERE json_extract_string(payload, '$.intent_disliked') = 'true'),
g AS (SELECT *, CASE WHEN ni IN ('Record', 'Action', 'Chitchat') THEN ni ELSE 'Record' END AS target FROM x
      WHERE ni IS NOT NULL OR nc IS NOT NULL),
h AS (SELECT c.*, lower(trim(c.text)) AS ck, g.target, g.nc,
      CASE WHEN g.target IS NULL THEN 'keep' WHEN g.target <> c.intent THEN 'move' ELSE 'update' END AS op
      FROM c LEFT JOIN g ON lower(trim(c.text)) = g.k AND place = CASE intent WHEN 'Record' THEN 1 WHEN 'Action' THEN 2 ELSE 3 END)
SELECT row_id, text, coalesce(target, intent) AS intent, coalesce(nc, category_code) AS category_code, op FROM h
QUALIFY op <> 'move' OR row_number() OVER (PARTITION BY ck, op ORDER BY row_id) = 1
UNION ALL
SELECT NULL, text_input, target, coalesce(nc, ''), 'insert' FROM g WHERE k NOT IN (SELECT lower(trim(text)) FROM c)""")
def _(t):
    corpus = t.A.selectExpr(
        "row_id", "concat('mua gạo ', row_id % 200, 'k') AS text",
        "CASE row_id % 3 WHEN 0 THEN 'Record' WHEN 1 THEN 'Action' ELSE 'Chitchat' END AS intent",
        "CASE WHEN row_id % 4 = 0 THEN 'cat_old' END AS category_code")
    return dedupe.merge_feedback(corpus, t.F)


CORRECTIONS = """row_id AS correction_id, user_id, concat(CASE WHEN row_id % 2 = 0 THEN 'MUA gạo ' ELSE 'bán gạo ' END,
row_id % 50, 'k momo') AS text, 'cat_food' AS category_code, 'log' AS intent, 'Expense' AS record_type"""


@query("j5_match_correction", f"""WITH c AS (SELECT *, {duck.clean_category('text')} AS ck FROM
(SELECT {CORRECTIONS} FROM @F f WHERE log_type = 'dislike') z),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, ck ORDER BY correction_id) = 1)
SELECT f.row_id, f.user_id, d.correction_id, 'Record' AS intent, d.category_code, d.record_type FROM @F f
JOIN d ON f.user_id = d.user_id AND {duck.clean_category('f.text_input')} = d.ck""")
def _(t):
    fixes = t.F.filter("log_type = 'dislike'").selectExpr(*[
        c.strip() for c in ("row_id AS correction_id", "user_id",
                            "concat(CASE WHEN row_id % 2 = 0 THEN 'MUA gạo ' ELSE 'bán gạo ' END, row_id % 50, 'k momo') AS text",
                            "'cat_food' AS category_code", "'log' AS intent", "'Expense' AS record_type")])
    return dedupe.match_correction(t.F, fixes)


@query("j15_unique_across", """SELECT row_id, text, source FROM (
SELECT row_id, text, 'record' AS source, 0 AS p FROM @U u UNION ALL SELECT row_id, text, 'action', 1 FROM @A a
UNION ALL SELECT row_id, text_input, 'log', 2 FROM @F f) x
QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY p, row_id) = 1""")
def _(t):
    log = t.F.select("row_id", F.col("text_input").alias("text"))
    return dedupe.unique_across([t.U, t.A, log], ["record", "action", "log"])
