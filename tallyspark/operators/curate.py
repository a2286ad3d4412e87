"""Row rules over the corpus tables: conform, filter, relabel, validate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import text as tx
from tallyspark.functions.text import first_match, fold, fold_marks, matches


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; missing ones are NULL."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def keep_types(df: DataFrame, types: Sequence[str], column: str = "type") -> DataFrame:
    return df.filter(F.col(column).isin(list(types)))


def remap(df: DataFrame, column: str, table: dict[str, str]) -> DataFrame:
    return df.withColumn(column, tx.lookup(F.col(column), table, F.col(column)))


def normalise_action(df: DataFrame) -> DataFrame:
    """Canonical action types; the legacy edit type is split by delete words."""
    action, low = F.col("action_type"), F.lower("text")
    deletes = tx.contains_any(low, rules.DELETE_WORDS)
    edit = F.when(deletes, F.lit("DELETE_RECORD")).otherwise(F.lit("UPDATE_RECORD"))
    return df.withColumn(
        "action_type", F.when(action == "Edit", edit).otherwise(tx.lookup(action, rules.ACTION_ALIASES, action)))


def drop_labels(df: DataFrame, labels: Sequence[str], column: str = "action_type") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(list(labels)), F.lit(False)))


def dropped_count(df: DataFrame, labels: Sequence[str], column: str = "action_type") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(F.coalesce(F.col(column).isin(list(labels)), F.lit(False))).alias("dropped"))


def has_money(col: Column) -> Column:
    """A money expression that ends at a word boundary."""
    return matches(col, rules.MONEY + r"\b")


def drop_polluted(df: DataFrame, label: str = "REPORT_GENERAL") -> DataFrame:
    bad = (F.col("action_type") == label) & has_money(F.col("text"))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def relabel_if(df: DataFrame, column: str, old: str, new: str, pattern: str) -> DataFrame:
    hit = (F.col(column) == old) & matches(F.col("text"), pattern)
    return df.withColumn(column, F.when(hit, F.lit(new)).otherwise(F.col(column)))


def relabel_two_sets(df: DataFrame, column: str, old: str, new: str, first: Iterable[str],
                     second: Iterable[str]) -> DataFrame:
    low = F.lower(tx.strip(F.col("text")))
    hit = (F.col(column) == old) & tx.contains_any(low, first) & tx.contains_any(low, second)
    return df.withColumn(column, F.when(hit, F.lit(new)).otherwise(F.col(column)))


def drop_matching(df: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    return df.filter(~F.coalesce(matches(F.col(column), pattern), F.lit(False)))


EXPORT_VERB = r"xuất\b(?! đề)|export\b"


def is_action_like(col: Column) -> Column:
    """A question about spending without any money in it."""
    low = fold_marks(tx.strip(col))
    return ~has_money(low) & matches(low, rules.ACTION_LIKE)


def split_action_like(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Both come from one projection; cache the parent when both are used."""
    flagged = df.withColumn("_action", is_action_like(F.col("text")))
    kept = flagged.filter(~F.coalesce("_action", F.lit(False))).drop("_action")
    return kept, flagged.filter("_action").drop("_action")


def fix_type_label(df: DataFrame) -> DataFrame:
    """Selling is income (Business unless already an income label); buying is expense unless refunded."""
    t, kind = fold(F.col("text")), F.lower("type")
    sell = matches(t, rules.SELL)
    buy = ~sell & matches(t, rules.BUY) & (kind == "income") & ~matches(t, rules.REFUND)
    keep = F.coalesce(F.col("label").isin("Business", "Salary", "Bonus", "Investment"), F.lit(False))
    return (df.withColumn("_sell", sell).withColumn("_buy", buy)
            .withColumn("type", F.when(F.col("_sell"), "income").when(F.col("_buy"), "expense").otherwise(F.col("type")))
            .withColumn("label", F.when(F.col("_sell") & ~keep, "Business").otherwise(F.col("label")))
            .drop("_sell", "_buy"))


def category_hint(col: Column) -> Column:
    t = fold(col)
    return first_match([
        (matches(t, rules.GIFT_BUY), "Essentials"),
        (matches(t, rules.GADGET), "Shopping"),
        (matches(t, rules.GROCERY), "Essentials"),
        (matches(t, rules.OUTING_CAFE) | matches(t, rules.OUTING_OTHER), "Entertainment"),
        (matches(t, rules.COFFEE), "Food"),
        (matches(t, rules.MEAT) & ~matches(t, rules.SELL), "Food"),
    ])


def apply_hint(df: DataFrame) -> DataFrame:
    """Expense rows take the hinted label where it differs."""
    hint = category_hint(F.col("text"))
    hit = hint.isNotNull() & (F.lower("type") == "expense") & ~F.col("label").eqNullSafe(hint)
    return df.withColumn("label", F.when(hit, hint).otherwise(F.col("label")))


def is_family_gift(col: Column) -> Column:
    t = fold_marks(col)
    return matches(t, rules.FAMILY_GIFT) & ~matches(t, rules.FAMILY_VETO)


def fix_family_gift(df: DataFrame) -> DataFrame:
    hit = ((F.lower("type") == "income") & (F.col("is_money") == 1) & (F.col("label") == "Business")
           & is_family_gift(F.col("text")))
    return df.withColumn("label", F.when(hit, "Bonus").otherwise(F.col("label")))


def gift_to_income(df: DataFrame) -> DataFrame:
    """A gift from family is income and a bonus whatever it was labelled."""
    gift = is_family_gift(F.col("text"))
    return (df.withColumn("_gift", gift)
            .withColumn("type", F.when(F.col("_gift"), "income").otherwise(F.col("type")))
            .withColumn("label", F.when(F.col("_gift"), "Bonus").otherwise(F.col("label"))).drop("_gift"))


def fix_disambiguation(df: DataFrame) -> DataFrame:
    """The whole boundary-rule chain over the kept rows, in one projection."""
    kept, _ = split_action_like(df)
    return kept.transform(fix_type_label).transform(gift_to_income).transform(apply_hint)


def change_stats(before: DataFrame, after: DataFrame, columns: Sequence[str] = ("type", "label")) -> DataFrame:
    """How many rows differ per column between two versions of a table."""
    right = after.select("row_id", *[F.col(c).alias(f"_{c}") for c in columns])
    counts = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_changed") for c in columns]
    return before.join(right, "row_id").agg(*counts)


def override_exact(df: DataFrame, overrides: DataFrame, column: str) -> DataFrame:
    """Labels by exact trimmed text. ``overrides`` has text and label, one row per text."""
    table = overrides.select(F.col("text").alias("_text"), F.col("label").alias("_label"))
    joined = df.join(table, tx.strip(F.col("text")) == F.col("_text"), "left")
    return joined.withColumn(column, F.coalesce("_label", column)).drop("_text", "_label")


def validate_record(df: DataFrame) -> DataFrame:
    """Cleaned record row plus ``reason``; NULL reason means the row is good."""
    text = tx.strip_hash_id(F.col("text"))
    label, kind = tx.strip(F.col("label")), F.lower(tx.strip(F.col("type")))
    flag = F.col("is_money").try_cast("int")
    labels = rules.CATEGORIES + ["Saving"]
    return df.select(
        "row_id", text.alias("text"), F.when(label == "Saving", "Savings").otherwise(label).alias("label"),
        kind.alias("type"), F.when(flag.isin(0, 1), flag).otherwise(1).alias("is_money"),
        first_match([
            (F.length(text) < 2, "short_text"),
            (~F.coalesce(label.isin(labels), F.lit(False)), "bad_label"),
            (~F.coalesce(kind.isin(rules.RECORD_TYPES), F.lit(False)), "bad_type"),
        ]).alias("reason"))


def validate_slots(df: DataFrame, categories: Sequence[str] = tuple(rules.CATEGORIES)) -> DataFrame:
    """Slots allowed for the action and inside their value sets; ``reason`` names the first defect."""
    text, action = tx.strip(F.col("text")), F.upper(tx.strip(F.col("action_type")))
    allowed = F.coalesce(
        F.try_element_at(F.create_map(*[
            x for a, slots in rules.SLOTS_BY_ACTION.items() for x in (F.lit(a), F.array(*map(F.lit, slots)))]), action),
        F.array().cast("array<string>"))
    checks = {
        "verb": lambda v: F.upper(v).isin(rules.VERBS),
        "category_code": lambda v: v.isin(list(categories)),
        "theme": lambda v: F.lower(v).isin(rules.THEMES),
        "verbal_style": lambda v: F.lower(v).isin(rules.VERBAL_STYLES),
    }

    def slot(name: str) -> Column:
        value = F.col(name)
        ok = F.array_contains(allowed, name) & (value != "")
        if name in checks:
            ok = ok & checks[name](value)
        clean = tx.strip(value)
        if name == "value":
            number = value.try_cast("double")
            clean = F.when(number.isNotNull() & ~F.isnan(number), number.try_cast("bigint").cast("string")).otherwise(clean)
        return F.when(F.coalesce(ok, F.lit(False)), clean)

    slots = [c for c in rules.SLOT_COLUMNS if c in df.columns]
    out = df.select("row_id", text.alias("text"), action.alias("action_type"), allowed.alias("_allowed"),
                    *[slot(c).alias(c) for c in slots])
    needed = [c for c in slots if c not in ("category_code", "note")]
    missing = F.array_compact(F.array(*[
        F.when(F.array_contains("_allowed", c) & F.coalesce(F.col(c) == "", F.lit(True)), F.lit(c)) for c in needed]))
    length = F.length("text")
    return out.withColumn("reason", first_match([
        ((length < 4) | (length > 200), "bad_length"),
        (F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
    ])).drop("_allowed")


def parse_pipe(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Bar-separated lines to record rows.

    ``df`` has row_id and line, ``existing`` has text. Rejects bad labels, types and flags, long texts,
    income that starts with a buying verb, and texts known exactly or up to their amounts.
    """
    line = F.regexp_replace(F.regexp_replace(tx.strip(F.col("line")), r"^```\w*\s*", ""), r"```\s*$", "")
    parts = F.transform(F.split(line, r"\|"), tx.strip)
    rows = df.select("row_id", line.alias("line"), parts.alias("p")).filter(
        ~F.col("line").startswith("#") & (F.size("p") >= 4))
    rows = rows.select(
        "row_id", tx.collapse_ws(F.get("p", F.lit(0))).alias("text"), F.get("p", F.lit(1)).alias("label"),
        F.get("p", F.lit(2)).alias("type"), F.get("p", F.lit(3)).try_cast("int").alias("is_money"))
    buys = (F.col("type") == "income") & matches(F.col("text"), r"^(?:mua|chi|order|thanh toán|trả|đóng)\b")
    good = rows.filter(
        F.col("label").isin(rules.CATEGORIES) & F.col("type").isin(rules.RECORD_TYPES)
        & F.col("is_money").isin(0, 1) & F.length("text").between(1, 120) & ~buys)
    from tallyspark.operators.dedupe import append_new_masked
    return append_new_masked(existing, good)


def merge_by_index(batch: DataFrame, lines: DataFrame, cap: int = 72) -> DataFrame:
    """Cleaned lines ``index | text | ...`` put back on their rows; rows without a line keep their text."""
    parts = F.transform(F.split("line", r"\|"), tx.strip)
    parsed = lines.select(F.col("line_no"), parts.alias("p")).filter(F.size("p") >= 5).select(
        "line_no", F.get("p", F.lit(0)).try_cast("bigint").alias("row_id"),
        F.regexp_replace(F.get("p", F.lit(1)), "^[\"']+|[\"']+$", "").alias("_clean")).filter("row_id IS NOT NULL")
    from tallyspark.operators.ordering import keep_first
    last = keep_first(parsed, "row_id", [F.desc("line_no")]).drop("line_no")
    text = F.substring(tx.strip(F.coalesce("_clean", "text")), 1, cap)
    return batch.join(last, "row_id", "left").withColumn("text", text).drop("_clean")


def flat_violations(df: DataFrame) -> DataFrame:
    """One row per broken rule of a flat benchmark row (absent values are the word None)."""
    intent, cat = F.col("expected_intent"), F.col("expected_category")
    rec, act = F.col("expected_record_type"), F.col("expected_action_type")
    record, action = intent == "Record", intent == "Action"
    found = F.array(
        F.when(~intent.isin(rules.INTENTS), "bad_intent"),
        F.when(record & ~rec.isin(rules.RECORD_TYPES), "bad_record_type"),
        F.when(record & (rec == "expense") & ~cat.isin(rules.BENCHMARK_EXPENSE), "bad_expense_category"),
        F.when(record & (rec == "income") & ~cat.isin(rules.BENCHMARK_INCOME), "bad_income_category"),
        F.when(record & (act != "None"), "record_with_action"),
        F.when(action & ~act.isin(rules.BENCHMARK_ACTIONS), "bad_action"),
        F.when(action & (rec != "None"), "action_with_record_type"),
        F.when(action & act.isin(rules.NO_CATEGORY_ACTIONS) & (cat != "None"), "action_with_category"),
        F.when((intent == "Chitchat") & ((cat != "None") | (rec != "None") | (act != "None")), "chitchat_with_labels"),
    )
    return df.select("row_id", F.explode(F.array_compact(found)).alias("violation"))


def slot_not_in_text(df: DataFrame, column: str = "goal_name") -> DataFrame:
    """Rows where no word of the slot occurs in the text."""
    words = F.filter(F.split(tx.collapse_ws(F.lower(column)), " "), lambda w: w != "")
    low = F.lower("text")
    return df.filter((F.col(column) != "") & ~F.exists(words, lambda w: F.contains(low, w)))


def slot_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.size(F.array_compact(F.array(*[tx.blank_to_null(F.col(c)) for c in columns])))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(cells > 0).alias("labelled_rows"),
                  F.sum(cells).cast("bigint").alias("labelled_cells"))


def replace_block(df: DataFrame, low: int, high: int, block: DataFrame) -> DataFrame:
    """Rows with row_id in [low, high) give way to ``block``."""
    return df.filter((F.col("row_id") < low) | (F.col("row_id") >= high)).unionByName(block)


def shorten(text: Column, label: Column, kind: Column) -> Column:
    """Long notes cut down to what and how much, at most 72 characters."""
    t = tx.strip(text)
    low = F.lower(t)
    nay = r"(?iU)^nay\s+có\s+khoản\s+về\s+từ\s+(.+?),\s*(.+?)\s+chuyển\s+khoản.*$"
    nay_core = F.concat_ws(
        " ", tx.strip(F.regexp_extract(t, nay, 1)),
        F.regexp_replace(tx.strip(F.regexp_extract(t, nay, 2)), r"(?iU)\s*(?:đồng|vnđ|vnd)\s*$", ""))
    money = tx.strip(F.regexp_extract(t, tx.FLAGS + "(" + rules.NOTE_MONEY + ")", 1))

    bare = F.regexp_replace(t, tx.FLAGS + rules.STORY_PREFIX, "")
    bare = F.regexp_replace(bare, tx.FLAGS + rules.PLACE_PART, "")
    bare = F.regexp_replace(bare, tx.FLAGS + rules.PAY_SUFFIX, "")

    def tidy(col: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(col, tx.FLAGS + rules.FILLERS, " "), r"(?U)\s+", " ")
        return F.regexp_replace(words, r"^[ ,.]+|[ ,.]+$", "")

    core = tidy(F.regexp_replace(F.regexp_replace(bare, r"^[^:]*:\s*", ""), r"^\s*\+\s*", ""))
    digits = r"[+0-9][0-9.,kKtrcủcu\s]*"
    chunk = tx.strip(F.substring(tx.strip(F.regexp_replace(core, digits, "")), 1, 40))
    chunk = F.when(chunk == "", F.lower(label)).otherwise(chunk)
    income = F.when((money != "") & ~F.contains(core, money), F.concat_ws(" ", chunk, money)).otherwise(
        F.when(core == "", t).otherwise(core))

    paid = F.regexp_replace(
        bare, r"(?iU)^(mua|chi|order|thanh toán|trả|đóng|đăng ký|dang ky)\s+(.+?)\s+"
              r"(?:tổng|tong|mất|mat|hết|het|chốt|chot)\s+", "$1 $2 ")
    paid = tidy(F.regexp_replace(paid, r"(?iU)\s+(?:bằng|bang|qua)\s+(?:tiền mặt|quet the|quẹt thẻ)[^,]*", ""))
    verb = first_match([(low.startswith(v), v) for v in rules.NOTE_VERBS], "mua")
    what = F.regexp_replace(paid, digits, "")
    what = F.substring(tx.strip(F.regexp_replace(
        what, tx.FLAGS + "^(?:" + "|".join(rules.NOTE_VERBS) + r")\s+", "")), 1, 35)
    expense = F.when((F.length(paid) > 50) & (money != "") & (what != ""), F.concat_ws(" ", verb, what, money))
    expense = F.coalesce(expense, F.when(paid != "", paid), t)

    is_income = (kind == "income") | low.contains("nhan tien") | low.contains("nhận tiền")
    long_form = F.when(t.rlike(nay), nay_core).when(is_income, income).otherwise(expense)
    return F.when(F.length(t) <= 40, t).otherwise(F.substring(tx.strip(long_form), 1, 72))


def canon_intent(col: Column, unknown: str = "Unknown") -> Column:
    return F.when(col.isNotNull(), tx.lookup(F.lower(tx.strip(col)), rules.INTENT_ALIASES, F.lit(unknown)))


def canon_type(col: Column) -> Column:
    return tx.lookup(F.lower(tx.strip(col)), rules.TYPE_ALIASES, col)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
