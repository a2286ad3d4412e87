"""Rule baseline, multi-record split and span choice."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import money, payload
from tallyspark.functions import text as tx
from tallyspark.functions.text import contains_any, first_match, fold_marks


def folded(word: str) -> str:
    """Rule words in the form of ``fold_marks`` text."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn").lower()


def multi_records(df: DataFrame) -> DataFrame:
    """One row per segment with an amount, for texts that have at least two such segments."""
    rows = df.select("row_id", F.transform(tx.split_segments(F.col("text")), lambda s: F.struct(
        s.alias("segment"), money.extract_amounts(s).alias("amounts"))).alias("_parts"))
    rows = rows.withColumn("_parts", F.filter("_parts", lambda p: F.size(p["amounts"]) > 0)).filter(F.size("_parts") >= 2)
    out = rows.select("row_id", F.posexplode("_parts").alias("pos", "p"))
    return out.select("row_id", "pos", F.col("p.segment").alias("segment"), F.get("p.amounts", F.lit(0)).alias("amount"),
                      money.clean_content(F.col("p.segment")).alias("item"))


def payload_fields(log: DataFrame) -> DataFrame:
    """Chat log with its payload opened, defaults filled and the category put into empty slots."""
    rows = log.withColumn("p", F.from_json("payload", payload.PAYLOAD)).filter("p IS NOT NULL")
    slots = F.coalesce("p.slots", F.create_map().cast("map<string,string>"))
    lacks = F.coalesce(F.try_element_at(slots, F.lit("category")), F.lit("")) == ""
    add = lacks & F.col("category").isNotNull()
    rest = F.map_filter(slots, lambda k, v: k != "category")
    filled = F.when(add, F.map_concat(rest, F.create_map(F.lit("category"), F.coalesce("category", F.lit(""))))).otherwise(slots)
    return rows.select(
        "row_id", "text_input", F.coalesce("intent", "p.intent", F.lit("Record")).alias("intent"), F.col("p.action_type").alias("action_type"),
        filled.alias("slots"), F.col("p.suggested_actions").alias("suggested_actions"), F.coalesce("p.emotion", F.lit("neutral")).alias("emotion"),
        F.coalesce("p.response", F.lit("Đã hiểu yêu cầu.")).alias("response"), F.coalesce("p.contextMeta", F.lit("{}")).alias("context"))


def loose_amounts(col: Column) -> Column:
    """Baseline amounts: number with an optional unit, at least 1000."""
    pattern = r"(?iU)([0-9]+(?:[.,][0-9]+)?)\s?(k|đ|d|vnđ|vnd|ngan|nghìn|nghin|triệu|trieu|củ|cu|tr)?"
    numbers = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    units = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(2)), F.lower)

    def value(n: Column, u: Column) -> Column:
        factor = first_match([(u.isin("k", "nghin", "nghìn", "ngan"), 1_000.0), (u.isin("triệu", "trieu", "củ", "cu", "tr"), 1_000_000.0)], 1.0)
        return F.translate(n, ",", ".").try_cast("double") * factor

    return F.filter(F.zip_with(numbers, units, value), lambda v: v >= 1000)


def _count(norm: Column, words: list[str]) -> Column:
    parts = [F.contains(norm, F.lit(folded(w))).cast("int") for w in words]
    return sum(parts[1:], parts[0])


def baseline_category(norm: Column) -> Column:
    """Most keyword hits wins, first category on ties; ``norm`` is a folded column."""
    ranked = F.array(*[F.struct(_count(norm, words).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
                       for i, (c, words) in enumerate(rules.BASELINE_KEYWORDS.items())])
    best = F.array_max(ranked)
    return F.get(F.transform(F.array(best), lambda b: F.when(b["s"] > 0, b["c"]).otherwise("Others")), F.lit(0))


def rule_baseline(df: DataFrame) -> DataFrame:
    """Intent, confidence, amount, category and record type by rules alone."""
    rows = tx.let(df.select("row_id", "text"), norm=fold_marks(F.col("text")), amounts=loose_amounts(F.col("text")))
    action = contains_any(F.col("norm"), [folded(w) for w in rules.BASELINE_ACTION])
    has = F.size("amounts") > 0
    short = F.size(F.split(tx.collapse_ws(F.col("norm")), " ")) <= 5
    rows = rows.withColumn("intent", first_match([(action, "Action"), (has, "Record")], "Chitchat")).withColumn(
        "confidence", first_match([(F.col("intent") == "Action", 0.7), (has, 0.85), (short, 0.6)], 0.5))
    record = F.col("intent") == "Record"
    income = contains_any(F.col("norm"), [folded(w) for w in rules.BASELINE_INCOME])
    return rows.select(
        "row_id", "text", "intent", "confidence", F.get("amounts", F.lit(0)).alias("amount"),
        F.when(record, baseline_category(F.col("norm"))).alias("category"),
        F.when(record, F.when(income, "Income").otherwise("Expense")).alias("record_type"))


def plain_receipts(texts: DataFrame) -> DataFrame:
    """Line count, largest amount and category of receipts given as plain text."""
    rows = tx.let(texts.select("row_id", "text"), norm=fold_marks(F.col("text")), _a=loose_amounts(F.col("text")))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return rows.select("row_id", lines.alias("lines"), F.array_max("_a").alias("amount"), baseline_category(F.col("norm")).alias("category"))


def longest_span(spans: Column) -> Column:
    """Longest non-blank span; the later one on ties."""
    ranked = F.transform(spans, lambda s, i: F.struct(F.length(tx.strip(s)).alias("l"), i.alias("i"), tx.strip(s).alias("s")))
    return F.array_max(F.filter(ranked, lambda r: r["l"] > 0))["s"]
