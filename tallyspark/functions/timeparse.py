"""Time phrases to date ranges (F22) as one ordered rule chain over folded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import first_match, fold, let, lookup

# --- fixed values: phrases (folded text) and the labels shown for them ---------------------------
DAY_RANGE = (r"(?:tu\s+)?(?:ngay\s+)?([0-9]{1,2})\s+(?:den|toi)\s+(?:ngay\s+)?([0-9]{1,2})"
             r"(?:\s+(?:thang\s+([0-9]{1,2})|thang\s+(nay|truoc)))?")
SLASH_RANGE = (r"([0-9]{1,2})[/\-]([0-9]{1,2})(?:[/\-]([0-9]{4}))?\s+(?:den|toi)\s+(?:ngay\s+)?"
               r"([0-9]{1,2})[/\-]([0-9]{1,2})(?:[/\-]([0-9]{4}))?")
DAYS_BACK = r"\b([0-9]+)\s*ngay\s*qua\b"
WEEKDAYS = [
    (r"\bthu (?:2|hai)\b", "monday", "Thứ hai"), (r"\bthu (?:3|ba)\b", "tuesday", "Thứ ba"),
    (r"\bthu (?:4|tu)\b", "wednesday", "Thứ tư"), (r"\bthu (?:5|nam)\b", "thursday", "Thứ năm"),
    (r"\bthu (?:6|sau)\b", "friday", "Thứ sáu"), (r"\bthu (?:7|bay)\b", "saturday", "Thứ bảy"),
    (r"\bchu nhat\b", "sunday", "Chủ nhật"),
]


LABELS = {
    "day": "Hôm nay", "yesterday": "Hôm qua", "week": "Tuần này", "last_week": "Tuần trước", "month": "Tháng này",
    "last_month": "Tháng trước", "quarter": "Quý này", "rolling_7d": "7 ngày qua", "rolling_30d": "30 ngày qua",
    "year": "Năm nay", "weekend": "Cuối tuần", "weekday": "Ngày thường", "holiday": "Ngày lễ",
    **{name: label for _, name, label in WEEKDAYS},
}


def _date(year: Column, month: Column, day: Column) -> Column:
    """NULL for a day that does not exist, so the next rule gets its turn."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, F.lit(0.0).cast("decimal(16,6)")).cast("date")


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parsed_phrases(phrases: DataFrame) -> DataFrame:
    """What a phrase (``_phrase``) says by itself, whatever the day: numbers of ranges, days back, first key word."""
    text = F.col("_text")
    rows = let(phrases, _text=fold(F.col("_phrase")))
    word = first_match([
        (text.rlike(r"\bhom nay\b"), "day"), (text.rlike(r"\bhom qua\b"), "yesterday"),
        (text.rlike(r"\btuan truoc\b|\btuan vua roi\b"), "last_week"), (text.rlike(r"\btuan nay\b"), "week"),
        (text.rlike(r"\bthang truoc\b"), "last_month"), (text.rlike(r"\bthang nay\b"), "month"),
        (text.rlike(r"\bquy nay\b"), "quarter"), (_int(text, DAYS_BACK, 1).isNotNull(), "rolling"),
        (text.rlike(r"\b7 ngay\b"), "rolling_7d"), (text.rlike(r"\b30 ngay\b"), "rolling_30d"),
        (text.rlike(r"\bcuoi tuan\b"), "weekend"), (text.rlike(r"\bngay thuong\b"), "weekday"), (text.rlike(r"\bngay le\b"), "holiday"),
        *[(text.rlike(p), name) for p, name, _ in WEEKDAYS],
        (text.rlike(r"\bthang\b"), "month"), (text.rlike(r"\btuan\b"), "week"), (text.rlike(r"\bngay\b"), "day"),
        (text.rlike(r"\bnam\b"), "year")])
    return rows.select(
        "_phrase", *[_int(text, DAY_RANGE, k).alias(f"_d{k}") for k in (1, 2, 3)], (F.regexp_extract(text, DAY_RANGE, 4) == "truoc").alias("_before"),
        (~text.rlike("[0-9]{1,2}/[0-9]{1,2}")).alias("_plain"), *[_int(text, SLASH_RANGE, k).alias(f"_s{k}") for k in range(1, 7)],
        _int(text, DAYS_BACK, 1).alias("_n"), word.alias("_word"))


def with_time_range(df: DataFrame, phrase: Column, anchor: Column, out: str) -> DataFrame:
    """``out`` = struct(granularity, start, end, label) of dates; NULL when no rule matches.

    Patterns run once per distinct phrase; its numbers and key word are joined back (broadcast by Spark as long as the
    phrases are few) and a row only adds its day. A range whose days do not exist leaves the turn to the next rule.
    """
    today = F.col("_today")
    rows = df.withColumns({"_phrase": phrase, "_today": anchor.cast("date")})
    rows = rows.join(parsed_phrases(rows.select("_phrase").distinct()), "_phrase", "left")
    base = F.when(F.col("_d3").isNull() & F.col("_before"), F.date_sub(F.trunc(today, "month"), 1)).otherwise(today)
    rows = let(rows, _y=F.year(base), _m=F.coalesce("_d3", F.month(base)))
    days_range = F.when(F.col("_plain"), F.struct(_date(F.col("_y"), F.col("_m"), F.col("_d1")).alias("a"), _date(F.col("_y"), F.col("_m"), F.col("_d2")).alias("b")))
    slash_range = F.struct(
        _date(F.coalesce("_s3", F.year(today)), F.col("_s2"), F.col("_s1")).alias("a"), _date(F.coalesce("_s6", F.year(today)), F.col("_s5"), F.col("_s4")).alias("b"))
    rows = let(rows, _d=days_range, _s=slash_range)

    def both(r: str) -> Column:
        return F.col(f"{r}.a").isNotNull() & F.col(f"{r}.b").isNotNull()

    rule = first_match([(F.coalesce(both("_d"), F.lit(False)), "days"), (both("_s"), "slashes")], F.col("_word"))
    rows = let(rows, _rule=rule, _week=F.date_trunc("week", today).cast("date"), _month=F.trunc(today, "month"))
    week, month, back = F.col("_week"), F.col("_month"), F.greatest(F.col("_n") - 1, F.lit(0))
    days = {name: i for i, (_, name, _) in enumerate(WEEKDAYS)}

    def pick(table: dict[str, Column], default: Column | None = None) -> Column:
        return first_match([(F.col("_rule") == name, value) for name, value in table.items()], default)

    start = pick({
        "days": F.col("_d.a"), "slashes": F.col("_s.a"), "yesterday": F.date_sub(today, 1), "last_week": F.date_sub(week, 7),
        "week": week, "last_month": F.add_months(month, -1), "month": month, "quarter": F.trunc(today, "quarter"),
        "rolling": F.date_sub(today, back), "rolling_7d": F.date_sub(today, 6), "rolling_30d": F.date_sub(today, 29),
        "weekend": F.date_add(week, 5), "weekday": week, "year": F.trunc(today, "year"),
        **{name: F.date_add(week, i) for name, i in days.items()}}, today)
    end = pick({
        "days": F.col("_d.b"), "slashes": F.col("_s.b"), "yesterday": F.date_sub(today, 1), "last_week": F.date_sub(week, 1),
        "last_month": F.date_sub(month, 1), "weekend": F.date_add(week, 6), "weekday": F.date_add(week, 4),
        **{name: F.date_add(week, i) for name, i in days.items()}}, today)
    rows = let(rows, _start=start, _end=end)
    custom = F.col("_rule").isin("days", "slashes")
    count = F.col("_n").cast("string")
    granularity = F.when(custom, "custom").when(F.col("_rule") == "rolling", F.concat(F.lit("rolling_"), count, F.lit("d"))).otherwise(F.col("_rule"))
    label = (F.when(custom, F.concat(F.lit("Từ "), F.date_format("_start", "dd/MM"), F.lit(" đến "), F.date_format("_end", "dd/MM/yyyy")))
             .when(F.col("_rule") == "rolling", F.concat(count, F.lit(" ngày qua"))).otherwise(lookup(F.col("_rule"), LABELS)))
    value = F.struct(granularity.alias("granularity"), F.col("_start").alias("start"), F.col("_end").alias("end"), label.alias("label"))
    return rows.withColumn(out, F.when(F.col("_rule").isNotNull(), value)).drop(
        "_phrase", "_today", "_y", "_m", "_d", "_s", "_n", "_rule", "_week", "_month", "_start", "_end", "_before", "_plain", "_word",
        *[f"_d{k}" for k in (1, 2, 3)], *[f"_s{k}" for k in range(1, 7)])


def period_label(r: Column) -> Column:
    """Label with its dates, e.g. ``Tuần này (25/05 - 31/05/2026)``."""
    end = F.date_format(r["end"], "dd/MM/yyyy")
    span = F.when(r["start"] == r["end"], end).otherwise(F.concat(F.date_format(r["start"], "dd/MM"), F.lit(" - "), end))
    return F.concat(r["label"], F.lit(" ("), span, F.lit(")"))


def bounds(r: Column) -> tuple[Column, Column]:
    """First and last second of the range, without time zone."""
    return r["start"].cast("timestamp_ntz"), (F.date_add(r["end"], 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND"))
