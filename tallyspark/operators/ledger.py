"""Ledger periods, user profiles and chat turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import timeparse


def rows_in_phrase(ledger: DataFrame, phrases: DataFrame) -> DataFrame:
    """Ledger rows inside the period of the user's phrase; ``phrases`` has user_id, phrase, anchor.

    Rows meet by user and month, so a busy user's history is read only where a period touches it.
    """
    ranges = timeparse.with_time_range(phrases, F.col("phrase"), F.col("anchor"), "_r").filter("_r IS NOT NULL")
    low, high = timeparse.bounds(F.col("_r"))
    ranges = ranges.select("user_id", F.col("_r.granularity").alias("granularity"), low.alias("_from"), high.alias("_to"))
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    ranges = ranges.withColumn("_month", F.explode(F.when(
        F.col("_to") >= F.col("_from"), F.sequence(month("_from"), month("_to"), F.expr("INTERVAL 1 MONTH")))))
    inside = ledger.withColumn("_month", month("ts")).join(ranges, ["user_id", "_month"])
    return inside.filter(F.col("ts").between(F.col("_from"), F.col("_to"))).drop("_from", "_to", "_month")


def compare_periods(ledger: DataFrame, slots: DataFrame) -> DataFrame:
    """Expense of two periods per request with difference and percent.

    ``slots`` has request_id, user_id, slot ("A vs B") and anchor; a user may ask for any number of comparisons.
    """
    parts = F.split("slot", r"(?iU)\s+vs\s+|\s+với\s+")
    rows = slots.withColumn("_p", parts)
    for i in (0, 1):
        rows = timeparse.with_time_range(rows, F.trim(F.get("_p", F.lit(i))), F.col("anchor"), f"_{i}")
    (a0, a1), (b0, b1) = timeparse.bounds(F.col("_0")), timeparse.bounds(F.col("_1"))
    rows = rows.select("request_id", "user_id", a0.alias("_a0"), a1.alias("_a1"), b0.alias("_b0"), b1.alias("_b1"))
    spent = ledger.filter("type = 'expense'").select("user_id", "ts", "amount").join(rows, "user_id").filter(
        F.col("ts").between(F.col("_a0"), F.col("_a1")) | F.col("ts").between(F.col("_b0"), F.col("_b1")))

    def total(x: str, y: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ts").between(F.col(x), F.col(y)), F.col("amount"))), F.lit(0))

    sums = spent.groupBy("request_id", "user_id").agg(total("_a0", "_a1").alias("first"), total("_b0", "_b1").alias("second"))
    diff = F.col("first") - F.col("second")
    return sums.select("request_id", "user_id", "first", "second", diff.alias("delta"),
                       F.round(F.try_divide(100.0 * diff, F.col("second")), 2).alias("percent"))


def profile(ledger: DataFrame, asof: str, budgets: DataFrame) -> DataFrame:
    """Spending features per user at a day; ``budgets`` has user_id and budget_total.

    Only the running month (and week) is read. Sums per (user, category) come first, so a very active user
    arrives at the second step as one row per category.
    """
    day = F.lit(asof).cast("date")
    month, week = F.trunc(day, "month"), F.date_trunc("week", day).cast("date")
    at = F.col("ts").cast("date")
    rows = ledger.filter((F.col("type") == "expense") & (at >= F.least(month, week)) & (at <= day))
    amount = F.col("amount")
    per_cat = rows.groupBy("user_id", "category").agg(
        F.sum(F.when(at == day, amount)).alias("t"), F.sum(F.when(at >= week, amount)).alias("w"),
        F.sum(F.when(at >= month, amount)).alias("m"), F.count_if(at >= week).alias("f"))
    total = F.sum("m")
    entries = F.array_sort(F.collect_list(F.struct("category", "f", F.coalesce("m", F.lit(0)).alias("m"))))
    users = per_cat.groupBy("user_id").agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("spent_today"), F.coalesce(F.sum("w"), F.lit(0)).alias("spent_week"),
        F.coalesce(total, F.lit(0)).alias("spent_month"), entries.alias("_e"))
    pct = lambda e: F.round(F.coalesce(F.try_divide(100.0 * e["m"], F.col("spent_month")), F.lit(0.0)), 1)
    stats = F.map_from_entries(F.transform("_e", lambda e: F.struct(e["category"], F.struct(
        e["f"].alias("frequency_week"), pct(e).alias("pct")))))
    return budgets.join(users, "user_id").select(
        "user_id", "spent_today", "spent_week", "spent_month", "budget_total",
        F.greatest(F.lit(0.0), F.col("budget_total") - F.col("spent_month")).alias("budget_remain"), stats.alias("category_stats"))


def last_user_message(turns: DataFrame) -> DataFrame:
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def history_block(turns: DataFrame) -> DataFrame:
    """Prior turns in order under the latest action result; a closing user turn is the question itself and left out.

    ``turns`` has conv_id, turn, role, text and action (NULL or the result text of a search or report).
    """
    last = F.max_by(F.struct("role", "turn"), "turn")
    who = F.when(F.col("role") == "user", F.lit("Người dùng")).otherwise(F.lit("Mascot MiMo"))
    line = F.concat(F.lit("- "), who, F.lit(": "), F.col("text"))
    rows = turns.groupBy("conv_id").agg(
        last.alias("last"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), "action"))).alias("all"))
    kept = F.when(F.col("last.role") == "user", F.filter("all", lambda t: t["turn"] < F.col("last.turn"))).otherwise(F.col("all"))
    rows = rows.withColumn("kept", kept)
    recent = F.element_at(F.filter("kept", lambda t: t["action"].isNotNull()), -1)["action"]
    recent = F.when(F.exists("kept", lambda t: t["action"].isNotNull()), recent)
    lines = F.array_join(F.transform("kept", lambda t: t["line"]), "\n")
    return rows.select("conv_id", F.concat_ws("\n\n", recent, F.concat(F.lit("LỊCH SỬ ĐỐI THOẠI GẦN ĐÂY:\n"), lines)).alias("block"))
