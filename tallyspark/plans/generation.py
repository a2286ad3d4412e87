"""Queries over generation and compilation: G1-G18. Topics, products and texts come from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import text as tx
from tallyspark.operators import generate
from tallyspark.operators.ordering import rank_by_id
from tallyspark.plans import duck
from tallyspark.plans.functions import amounts_sql
from tallyspark.plans.registry import query

TOPIC = "CASE o_custkey % 6 WHEN 0 THEN 'trà sữa' WHEN 1 THEN 'gạo' WHEN 2 THEN 'vé xe' WHEN 3 THEN 'áo khoác' WHEN 4 THEN 'thuốc cảm' ELSE 'đèn' END"


def _lst(values) -> str:
    return "[" + ", ".join(duck.lit(v) for v in values) + "]"


def _idx(key: str, salt: int) -> str:
    return f"CAST('0x' || substr(md5(concat('{salt}:', {key})), 1, 8) AS BIGINT)"


def _pick(values, index: str) -> str:
    return f"{_lst(values)}[({index}) % {len(values)} + 1]"


def _fill(pattern: str, **values: str) -> str:
    for name, value in values.items():
        pattern = f"replace({pattern}, '{{{name}}}', {value})"
    return pattern


def _topic_label(x: str) -> str:
    low = f"lower({x})"
    return "CASE " + " ".join(f"WHEN {duck.contains_any(low, w)} THEN '{c}'" for c, w in rules.TOPIC_LABELS) + " ELSE 'Essentials' END"


def _money(i: str) -> str:
    """Twelve spellings, as printf."""
    base = f"(6000 + ({i}) * 8353 % 2500000)"
    k = f"({base} // 1000)"
    return (f"CASE ({i}) * 29 % 12 WHEN 0 THEN {k} || 'k' WHEN 1 THEN {k} || 'K' WHEN 2 THEN {k} || ' xị' WHEN 3 THEN {k} || ' nghìn' WHEN 4 THEN {k} || ' ngàn' "
            f"WHEN 5 THEN {k} || ' ngan' WHEN 6 THEN {k} || ' nghin' WHEN 9 THEN {k} || 'k VND' WHEN 7 THEN replace(format('{{:,}}', {base}), ',', '.') || 'đ' "
            f"WHEN 8 THEN replace(format('{{:,}}', {base}), ',', '.') || ' vnd' ELSE CASE WHEN ({i}) * 29 % 12 = 10 AND {k} >= 80 THEN "
            f"regexp_replace(printf('%.2f', {base} / 1e6), '\\.?0+$', '') || ' tr' WHEN ({i}) * 29 % 12 = 11 AND {k} >= 500 THEN ({k} // 100) || ' củ' "
            f"WHEN {base} % 1000 > 0 THEN {k} || '.' || ({base} % 1000 // 100) || 'k' ELSE {k} || 'k' END END")


def _topics(t):
    return t.table("orders").selectExpr("o_orderkey AS row_id", f"{TOPIC} AS topic")


SPECS = ["báo cáo {t} tháng này", "đặt hạn mức {t} {m}", "cảnh báo {t} quá {m}"]
AMTS = ["500k", "1tr", "2tr"]
G1_ROWS = " UNION ALL ".join(
    f"SELECT row_id, {i} AS template, {j} AS amount, trim(replace(replace({duck.lit(s)}, '{{t}}', topic), '{{m}}', {duck.lit(a)})) AS text FROM s"
    for i, s in enumerate(SPECS) for j, a in enumerate(AMTS if "{m}" in s else [""]))


@query("g1_expand_templates", f"""WITH s AS (SELECT c_custkey AS row_id, concat(lower(c_mktsegment), ' ', c_nationkey) AS topic FROM customer), x AS ({G1_ROWS})
SELECT row_id, template, amount, text FROM x WHERE text NOT IN (SELECT text FROM @A a)""")
def _(t):
    rows = t.table("customer").selectExpr("c_custkey AS row_id", "concat(lower(c_mktsegment), ' ', c_nationkey) AS topic")
    made = generate.expand(rows, SPECS, AMTS).drop("topic")
    from tallyspark.operators.dedupe import minus
    return minus(made, t.A)


@query("g2_with_suffixes", f"""SELECT row_id, s AS suffix, trim(concat(text, {_lst(rules.BUDGET_SUFFIXES)}[s + 1])) AS text FROM
(SELECT c_custkey AS row_id, concat({_pick(rules.BUDGET_CORES, 'c_custkey')}, ' ', lower(c_mktsegment)) AS text, unnest(range({len(rules.BUDGET_SUFFIXES)})) AS s FROM customer) x""")
def _(t):
    rows = t.table("customer").select(F.col("c_custkey").alias("row_id"), F.concat(
        generate.pick(rules.BUDGET_CORES, F.col("c_custkey")), F.lit(" "), F.lower("c_mktsegment")).alias("text"))
    return generate.with_suffixes(rows, rules.BUDGET_SUFFIXES)


SHORT_TOPIC = "CASE o_custkey % 11 WHEN 0 THEN 'trà sữa' WHEN 1 THEN 'gạo' WHEN 2 THEN 'vé xe' WHEN 3 THEN 'áo khoác' WHEN 4 THEN 'đi grab về quê' WHEN 5 THEN 'Phở bò' WHEN 6 THEN 'tiền điện' WHEN 7 THEN 'cf sáng' WHEN 8 THEN 'kem chống nắng' WHEN 9 THEN 'đổ Xăng' ELSE 'siêu thị' END"
_ABBREV = "CASE " + " ".join(f"WHEN contains(lower(topic), {duck.lit(k)}) THEN {_lst(v)}" for k, v in rules.ABBREVIATIONS.items()) + " ELSE [] END"
SPELL = f"""s0 AS (SELECT o_orderkey AS row_id, {SHORT_TOPIC} AS topic FROM orders), s1 AS (SELECT *, list_concat([trim(topic)], {_ABBREV}) AS known, strip_accents(lower(topic)) AS plain FROM s0),
s2 AS (SELECT *, list_concat(list_concat(known, CASE WHEN list_contains([lower(x) for x in known], plain) THEN [] ELSE [plain] END),
CASE WHEN contains(topic, 'sữa') THEN [replace(topic, 'sữa', 'sửa')] ELSE [] END) AS l FROM s1),
s3 AS (SELECT row_id, topic, [l[i] for i in range(1, len(l) + 1) if list_position(l, l[i]) = i] AS l FROM s2),
spell AS (SELECT row_id, topic, CAST(unnest(range(len(l))) AS INT) AS variant, unnest(l) AS spelling FROM s3)"""


def _short_label(x: str) -> str:
    low, words = f"lower({x})", f"string_split_regex(lower({x}), '[^a-zA-Zà-ỹ0-9]+')"
    food = f"{duck.contains_any(low, rules.SHORT_FOOD_TOPICS)} OR list_contains({words}, 'cf') OR (list_contains({words}, 'hu') AND list_contains({words}, 'tieu')) OR list_has_any({words}, {_lst(rules.SHORT_FOOD_WORDS)})"
    return ("CASE " + " ".join(f"WHEN contains({low}, {duck.lit(k)}) THEN '{c}'" for k, c in rules.SHORT_TOPIC_LABELS)
            + f" WHEN {food} THEN 'Food' WHEN {duck.contains_any(low, rules.SHORT_BEAUTY)} THEN 'Beauty' ELSE 'Essentials' END")


def _short_topics(t):
    return t.table("orders").selectExpr("o_orderkey AS row_id", f"{SHORT_TOPIC} AS topic")


@query("g3_topic_variants", f"WITH {SPELL} SELECT row_id, variant, spelling FROM spell")
def _(t):
    return generate.topic_variants(_short_topics(t)).drop("topic")


@query("g4_topic_label", f"SELECT row_id, {_topic_label('topic')} AS label FROM (SELECT o_orderkey AS row_id, {TOPIC} AS topic FROM orders) o")
def _(t):
    return _topics(t).select("row_id", tx.topic_label(F.col("topic")).alias("label"))


_G5_KEY = "(row_id * 1000 + variant * 20 + tp)"
_G5_ALL = rules.EXPENSE_TEMPLATES + rules.PLACE_TEMPLATES


def _g5_fixed(pairs, place: int, kind: str, shift: int) -> str:
    return (f"SELECT o_orderkey * 1000 + {place} AS row_id, replace({_pick([x for x, _ in pairs], 'o_orderkey')}, '{{m}}', {_money(f'(o_orderkey + {shift})')}) AS text, "
            f"{_pick([c for _, c in pairs], 'o_orderkey')} AS label, '{kind}' AS type, 1 AS is_money FROM orders")


@query("g5_short_records", f"""WITH {SPELL}, z AS (SELECT *, unnest(range({len(_G5_ALL)})) AS tp FROM spell),
e AS (SELECT {_G5_KEY} AS row_id, {_fill(_lst(_G5_ALL) + '[tp + 1]', t='spelling', m=_money(_G5_KEY), p=_pick(rules.SHORT_PLACES, '(row_id + variant)'))} AS text,
{_short_label('topic')} AS label, 'expense' AS type, 1 AS is_money FROM z WHERE tp < {len(rules.EXPENSE_TEMPLATES)} OR (row_id + variant) % 3 = 0),
b AS (SELECT row_id * 1000 + variant * 20 + 19 AS row_id, spelling AS text, {_short_label('topic')} AS label, 'expense' AS type, 0 AS is_money FROM spell WHERE (row_id + variant) % 17 = 0)
SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM b UNION ALL {_g5_fixed(rules.SHORT_TEMPLATES, 998, 'expense', 0)} UNION ALL {_g5_fixed(rules.INCOME_TEMPLATES, 999, 'income', 500000)}) y
WHERE length(text) BETWEEN 1 AND 72 QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1""")
def _(t):
    return generate.short_records(_short_topics(t))


@query("g6_contrast_pairs", f"""SELECT row_id, concat(CASE k WHEN 0 THEN 'mua ' ELSE 'bán ' END, topic, ' ', a) AS text, CASE k WHEN 0 THEN {_topic_label('topic')} ELSE 'Business' END AS label,
CASE k WHEN 0 THEN 'expense' ELSE 'income' END AS type FROM (SELECT o_orderkey AS row_id, {TOPIC} AS topic, {_pick(rules.BALANCE_AMOUNTS, 'o_orderkey')} AS a, unnest([0, 1]) AS k FROM orders) x""")
def _(t):
    return generate.contrast_pairs(_topics(t).withColumn("amount", generate.pick(rules.BALANCE_AMOUNTS, F.col("row_id"))))


@query("g7_span_template", """SELECT row_id, concat('đặt hạn mức ', cat, ' là ', amt, 'k') AS text, 12 AS s1, 12 + length(cat) AS e1, 16 + length(cat) AS s2, 17 + length(cat) + length(amt) AS e2
FROM (SELECT c_custkey AS row_id, lower(c_mktsegment) AS cat, CAST(100 + c_nationkey AS VARCHAR) AS amt FROM customer) x""")
def _(t):
    rows = t.table("customer").selectExpr("c_custkey AS row_id", "lower(c_mktsegment) AS cat", "concat(100 + c_nationkey, 'k') AS amt")
    made = generate.span_template([(F.lit("đặt  hạn mức "), None), (F.col("cat"), "CATEGORY"), (F.lit("  là "), None), (F.col("amt"), "AMOUNT"), (F.lit(" "), None)])
    rows = rows.select("row_id", made.alias("m"))
    return rows.select("row_id", F.col("m.text").alias("text"), F.col("m.spans")[0]["start"].alias("s1"), F.col("m.spans")[0]["end"].alias("e1"),
                       F.col("m.spans")[1]["start"].alias("s2"), F.col("m.spans")[1]["end"].alias("e2"))


@query("g8_find_spans", """SELECT row_id, instr(text, 'gạo') - 1 AS start, instr(text, 'gạo') + 2 AS "end" FROM @U u WHERE contains(text, 'gạo') AND contains(text, 'mua')""")
def _(t):
    rows = t.U.select("row_id", generate.find_spans(F.col("text"), [(F.lit("gạo"), "PRODUCT"), (F.lit("mua"), "VERB")]).alias("s")).filter("s IS NOT NULL")
    return rows.select("row_id", F.col("s")[0]["start"].alias("start"), F.col("s")[0]["end"].alias("end"))


G9_LABEL = "coalesce(CASE label WHEN 'Saving' THEN 'Savings' ELSE label END, 'Others')"
G9_BASE = f"b AS (SELECT row_id, text, {G9_LABEL} AS label, type FROM @U u WHERE row_id % 2 = 0)"
_G9_KEY = "(row_id * 16 + i + 1099511627776)"
_INCOME_OF = "CASE label " + " ".join(f"WHEN '{c}' THEN {_lst([x for x, d in rules.INCOME_TEMPLATES if d == c])}" for c in sorted({c for _, c in rules.INCOME_TEMPLATES})) + " END"
_INCOME_ALL = [x for x, _ in rules.INCOME_TEMPLATES]


@query("g9_supplement", f"""WITH {G9_BASE}, c AS (SELECT label, count(*) AS n FROM b WHERE type IN ('expense', 'income') GROUP BY 1), m AS (SELECT quantile_cont(n, 0.5) AS med FROM c),
w AS (SELECT label, CASE WHEN label IN {duck.in_list(rules.INCOME_LABELS)} THEN 'income' ELSE 'expense' END AS wtype, CAST(least(greatest(2500, floor(med * 0.85)) - n, CASE label WHEN 'Others' THEN 3200 ELSE 1200 END) AS BIGINT) AS gap
FROM c, m WHERE greatest(2500, floor(med * 0.85)) > n ORDER BY greatest(2500, floor(med * 0.85)) - n DESC, label LIMIT 20),
p AS (SELECT row_id, {duck.strip_hash('text')} AS text, {G9_LABEL} AS label, type FROM @U u WHERE row_id % 2 = 1),
f AS (SELECT * FROM p WHERE text NOT IN (SELECT trim(text) FROM b) QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY row_id) = 1),
r AS (SELECT f.row_id, text, f.label, type FROM f JOIN w USING (label) QUALIFY row_number() OVER (PARTITION BY f.label ORDER BY row_id) <= gap),
h AS (SELECT w.label, wtype, gap - coalesce(n, 0) AS gap FROM w LEFT JOIN (SELECT label, count(*) AS n FROM r GROUP BY 1) a USING (label) WHERE gap > coalesce(n, 0)),
t AS (SELECT o_orderkey AS row_id, concat({SHORT_TOPIC}, ' ', o_orderkey % 500) AS topic FROM orders), tl AS (SELECT *, {_short_label('topic')} AS label FROM t),
tk AS (SELECT tl.*, wtype, gap FROM tl JOIN h USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id) <= gap),
te AS (SELECT *, unnest(range({len(rules.EXPENSE_TEMPLATES)})) AS i FROM tk WHERE wtype = 'expense'),
s1 AS (SELECT {_G9_KEY} AS row_id, {_fill(_lst(rules.EXPENSE_TEMPLATES) + '[i + 1]', t='topic', m=_pick(rules.BALANCE_AMOUNTS, _idx(_G9_KEY, 21)))} AS text, label, wtype AS type, gap FROM te),
ti AS (SELECT label, gap, {_INCOME_OF} AS ts, unnest(range(2 * gap + 1)) AS i FROM h WHERE wtype = 'income' AND {_INCOME_OF} IS NOT NULL),
s2 AS (SELECT i + 4398046511104 AS row_id, replace(ts[i % len(ts) + 1], '{{m}}', {_money('i')}) AS text, label, 'income' AS type, gap FROM ti),
k AS (SELECT trim(text) AS text FROM b UNION SELECT trim(text) FROM r),
s3 AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) z WHERE text NOT IN (SELECT text FROM k) QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1),
s AS (SELECT row_id, text, label, type FROM s3 QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id) <= gap),
ig AS (SELECT least(greatest(0, CAST(floor(count(*) FILTER (type = 'expense') * 0.18) AS BIGINT) - count(*) FILTER (type = 'income')), 1500) AS gap FROM b),
l1 AS (SELECT i + 8796093022208 AS row_id, replace({_pick(_INCOME_ALL, '(i + 77)')}, '{{m}}', {_money('(i + 77)')}) AS text, {_pick([c for _, c in rules.INCOME_TEMPLATES], '(i + 77)')} AS label, 'income' AS type FROM (SELECT unnest(range(3000)) AS i) z),
l2 AS (SELECT * FROM l1 WHERE text NOT IN (SELECT text FROM k) AND text NOT IN (SELECT text FROM s) QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1),
l AS (SELECT * FROM l2 QUALIFY row_number() OVER (ORDER BY row_id) <= (SELECT gap FROM ig))
SELECT row_id, text, label, type FROM (SELECT * FROM r UNION ALL SELECT * FROM s UNION ALL SELECT * FROM l) y QUALIFY row_number() OVER (PARTITION BY {duck.mask('text')} ORDER BY row_id) = 1""")
def _(t):
    rows = t.U.withColumn("label", F.expr(G9_LABEL))
    topics = t.table("orders").selectExpr("o_orderkey AS row_id", f"concat({SHORT_TOPIC}, ' ', o_orderkey % 500) AS topic")
    topics = topics.withColumn("label", tx.short_topic_label(F.col("topic")))
    return generate.supplement(rows.filter("row_id % 2 = 0"), t.U.filter("row_id % 2 = 1").withColumn("label", F.coalesce("label", F.lit("Others"))), topics)


@query("g10_balance_income", f"""WITH u AS (SELECT * FROM @U u), h AS (SELECT count(*) FILTER (type = 'income') AS n FROM u),
g AS (SELECT o_orderkey AS row_id, replace({_pick([x for x, _ in rules.INCOME_TEMPLATES], 'o_orderkey')}, '{{m}}', {_money('o_orderkey')}) AS text, {_pick([c for _, c in rules.INCOME_TEMPLATES], 'o_orderkey')} AS label, 'income' AS type FROM orders),
f AS (SELECT * FROM g WHERE text NOT IN (SELECT trim(text) FROM u) QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1)
SELECT * FROM f QUALIFY row_number() OVER (ORDER BY row_id) <= greatest(0, 3500 - (SELECT n FROM h))""")
def _(t):
    return generate.balance_income(t.U, t.table("orders").select(F.col("o_orderkey").alias("row_id")))


_PN = "regexp_replace(lower(trim(p_name)), '[^\\pL\\pN_\\s+]', '', 'g')"


@query("g11_augment_products", f"""SELECT row_id, label, b AS bucket, CASE b WHEN 'short' THEN concat(array_to_string(string_split({_PN}, ' ')[1:2], ' '), ' ', m)
ELSE replace(replace(replace(CASE label WHEN 'Food' THEN {_pick(rules.FOOD_TEMPLATES, 'i3')} ELSE {_pick(rules.GOODS_TEMPLATES, 'i3')} END, '{{t}}', {_PN}), '{{m}}', m), '{{c}}', c) END AS text
FROM (SELECT p_partkey AS row_id, p_name, CASE p_partkey % 2 WHEN 0 THEN 'Food' ELSE 'Essentials' END AS label, {_pick(rules.PRICES, _idx('p_partkey', 1))} AS m, {_pick(rules.COMPANIONS, _idx('p_partkey', 2))} AS c,
{_idx('p_partkey', 3)} AS i3, unnest(['short', 'long']) AS b FROM part) x""")
def _(t):
    return generate.augment_products(t.table("part").selectExpr("p_partkey AS row_id", "p_name AS name", "CASE p_partkey % 2 WHEN 0 THEN 'Food' ELSE 'Essentials' END AS kind"))


@query("g12_type_schedule", """SELECT row_id, CASE WHEN rn <= round_even(n * 0.70, 0) THEN 'expense' WHEN rn <= round_even(n * 0.70, 0) + round_even(n * 0.25, 0) THEN 'income' ELSE 'none' END AS type
FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM @U u WHERE label IS NOT NULL) x""")
def _(t):
    rows = t.U.filter("label IS NOT NULL").select("row_id", "label")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_by_id(rows, "label", rank="rn").join(sizes, "label")
    return ranked.select("row_id", generate.type_schedule(F.col("rn"), F.col("n")).alias("type"))


@query("g13_benchmark_flat", """SELECT row_id, text, intent AS expected_intent, coalesce(nullif(category_code, ''), 'None') AS expected_category, action_type AS expected_action_type, 'None' AS expected_record_type FROM @A a""")
def _(t):
    return generate.benchmark_tables(t.A)[1]


@query("g13_benchmark_nested", """SELECT row_id, action_type, category_code AS category, CASE WHEN NOT isnan(TRY_CAST(value AS DOUBLE)) THEN CAST(TRY_CAST(value AS DOUBLE) AS BIGINT) END AS amount FROM @A a""")
def _(t):
    return generate.benchmark_tables(t.A)[0].select("row_id", "action_type", F.col("slots.category").alias("category"), F.col("slots.amount").alias("amount"))


@query("g14_compile_rows", """SELECT row_id, source, input, intent, a, b FROM (
SELECT row_id, 'action' AS source, text AS input, 'Action' AS intent, action_type AS a, goal_name AS b FROM @A a
UNION ALL SELECT row_id, 'record', text, 'Record', label, type FROM @U u
UNION ALL SELECT conv_id * 100 + turn, 'chitchat', text, 'Chitchat', 'Neutral', NULL FROM conversations) x""")
def _(t):
    chats = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "text", F.lit("Neutral").alias("sentiment"))
    rows = generate.compile_rows(t.U, t.A, chats)
    get = lambda *names: F.coalesce(*[F.get_json_object("output", f"$.{n}") for n in names])
    return rows.select("row_id", "source", "input", get("intent").alias("intent"), get("action_type", "label", "sentiment").alias("a"), get("goal_name", "type").alias("b"))


@query("g15_compile_chat_log", """SELECT row_id, concat('Ngữ cảnh hệ thống (CONTEXT_META): {}', chr(10), 'Câu thoại của người dùng: ', text_input) AS input, intent,
coalesce(json_extract_string(payload, '$.slots.category'), category) AS category FROM @F f WHERE log_type = 'chat' QUALIFY row_number() OVER (PARTITION BY lower(trim(text_input)) ORDER BY row_id) = 1""")
def _(t):
    rows = generate.compile_chat_log(t.F)
    return rows.select("row_id", "input", F.get_json_object("output", "$.intent").alias("intent"), F.get_json_object("output", "$.slots.category").alias("category"))


@query("g16_format_prompts", f"""WITH d AS (SELECT row_id, text, label FROM @U u WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1),
c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY {duck.draw('row_id')}, row_id) <= 500), a AS ({amounts_sql('c', 'text', 'row_id, text, label')})
SELECT row_id, concat('Câu thoại của người dùng: ', text) AS prompt, label AS category, CAST(am[1] AS VARCHAR) AS amount FROM a""")
def _(t):
    rows = generate.format_prompts(t.U)
    return rows.select("row_id", "prompt", F.get_json_object("response", "$.category").alias("category"), F.get_json_object("response", "$.amount").alias("amount"))


NOTE_TOPIC = "concat(CASE p_partkey % 9 WHEN 0 THEN 'trà ' WHEN 1 THEN 'vé xe ' WHEN 2 THEN 'tiền điện ' WHEN 3 THEN 'áo ' WHEN 4 THEN 'serum ' WHEN 5 THEN 'thuốc ' WHEN 6 THEN 'sách ' ELSE '' END, lower(p_name)) AS topic"
_EVERY_PLACE = [p for places in rules.NOTE_PLACES.values() for p in places]


def _place(label: str, index: str) -> str:
    of = {k: [c for c, kind in rules.PLACE_OF_LABEL.items() if kind == k] for k in rules.NOTE_PLACES}
    return "CASE " + " ".join(f"WHEN {label} IN {duck.in_list(of[k])} THEN {_pick(places, index)}" for k, places in rules.NOTE_PLACES.items()) + f" ELSE {_pick(_EVERY_PLACE, index)} END"


_SLOTS = "CASE label " + " ".join(f"WHEN '{c}' THEN {_lst(ps)}" for c, ps in rules.BUCKET_PATTERNS.items()) + " ELSE ['{t}: {m}'] END"
_G17_TEXT = _fill("pattern", t="topic", v=_pick(rules.NOTE_VERBS, _idx("n", 11)), p=_place("label", _idx("n", 12)), m=_money("(" + _idx("n", 13) + " % 1000000)"))


@query("g17_bucket_notes", f"""WITH t AS (SELECT p_partkey AS row_id, {NOTE_TOPIC} FROM part), l AS (SELECT *, {_topic_label('topic')} AS label FROM t),
s AS (SELECT *, unnest({_SLOTS}) AS pattern, unnest(range(len({_SLOTS}))) AS pos FROM l), c AS (SELECT *, row_id * 4 + pos AS slot, unnest(range(6)) AS j FROM s),
d AS (SELECT *, slot * 16 + j AS n FROM c), x AS (SELECT n AS row_id, slot, {_G17_TEXT} AS text, label FROM d),
f AS (SELECT * FROM x WHERE text NOT IN (SELECT trim(text) FROM @U u) QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY row_id) = 1),
k AS (SELECT row_id, text, label FROM f QUALIFY row_number() OVER (PARTITION BY slot ORDER BY row_id) <= 3),
m AS (SELECT (SELECT count(*) FROM part) * 5 - (SELECT count(*) FROM k) AS missing),
p AS (SELECT 1099511627776 + i AS row_id, replace({_pick([x for x, _ in rules.PAD_PATTERNS], 'i')}, '{{m}}', {_money('i')}) AS text, {_pick([c for _, c in rules.PAD_PATTERNS], 'i')} AS label
FROM (SELECT unnest(range(CASE WHEN missing > 0 THEN {generate.PAD_NUMBERS} ELSE 0 END)) AS i FROM m) z),
q AS (SELECT * FROM p WHERE text NOT IN (SELECT text FROM k) AND text NOT IN (SELECT trim(text) FROM @U u) QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1),
r AS (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY row_id) <= (SELECT missing FROM m)) SELECT * FROM k UNION ALL SELECT * FROM r""")
def _(t):
    topics = t.table("part").selectExpr("p_partkey AS row_id", NOTE_TOPIC)
    return generate.bucket_notes(topics, t.U, total=5 * topics.count())


_NOTE = {"p": _place("label", _idx("row_id", 9)), "w": _pick(rules.NOTE_WAYS, _idx("row_id", 10)), "f": _pick(rules.NOTE_FILLERS, _idx("row_id", 14))}
G18_ITEM = "trim(regexp_replace(text, '[0-9].*$', '')) AS item"


@query("g18_pattern_notes", f"""WITH r AS (SELECT row_id, {G18_ITEM}, label, type, {_pick(rules.PRICES, _idx('row_id', 5))} AS price, type IN ('income', 'expense') AS paid FROM @U u WHERE label IS NOT NULL),
m AS (SELECT *, {_fill("CASE type WHEN 'income' THEN " + _pick(rules.EARN_PATTERNS, _idx('row_id', 6)) + " WHEN 'expense' THEN " + _pick(rules.SPEND_PATTERNS, _idx('row_id', 6)) + " ELSE " + _pick(rules.NOISE_PATTERNS, _idx('row_id', 6)) + " END", t="item", m="price", **_NOTE)} AS base,
CASE WHEN NOT paid THEN '' WHEN label = 'Transport' AND {_idx('row_id', 7)} % 4 = 0 THEN concat(', đổ ', {_idx('row_id', 15)} % 9 + 1, ' lít')
WHEN label IN ('Shopping', 'Housing') AND {_idx('row_id', 7)} % 5 = 0 THEN concat(', giao từ ', {_pick(rules.NOTE_PLACES['office'], _idx('row_id', 16))}) ELSE '' END AS more,
CASE WHEN paid AND label IN ('Education', 'Housing') AND {_idx('row_id', 8)} % 4 = 0 THEN ', trả hằng tháng' ELSE '' END AS regular FROM r)
SELECT row_id, concat(base, more, regular) AS text, label, type, CASE WHEN paid THEN price ELSE '0k' END AS amount FROM m
QUALIFY row_number() OVER (PARTITION BY concat(base, more, regular) ORDER BY row_id) = 1""")
def _(t):
    return generate.pattern_notes(t.U.filter("label IS NOT NULL").selectExpr("row_id", G18_ITEM, "label", "type"))
