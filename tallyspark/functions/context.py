"""Spending context: time buckets, wallet health, triggers, facts, kept fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import contains_any, first_match, lookup

# --- fixed values: codes, display labels, words that mention a field ------------------------------
UNKNOWN = "không_rõ"
TIME_LABELS = {"sáng_sớm": "Sáng sớm", "buổi_trưa": "Trưa nắng", "chiều_tối": "Chiều muộn", "đêm_muộn": "Đêm khuya"}
HEALTH_LABELS = {"an_toan": "rủng rỉnh", "can_than": "tạm ổn", "bao_dong": "đang báo động", "không_rõ": "tạm ổn"}
MENTIONS = {
    "weather": ["thời tiết", "mưa", "nắng", "trời", "weather"],
    "days_to_payday": ["lương", "payday", "tiền về", "nhận lương"],
    "time_of_day": ["giờ", "buổi", "sáng", "trưa", "chiều", "tối", "đêm", "ngày"],
    "spent_last_month": ["tháng trước", "tháng ngoái", "last month", "so với tháng trước", "so sánh tháng trước"],
}


def time_of_day(hour: Column) -> Column:
    return first_match([(hour.between(5, 10), "sáng_sớm"), (hour.between(11, 13), "buổi_trưa"),
                        (hour.between(14, 18), "chiều_tối")], "đêm_muộn")


def days_to_payday(day: Column) -> Column:
    """Payday is the 15th, then the 30th."""
    return F.when(day <= 15, 15 - day).otherwise(F.greatest(F.lit(0), 30 - day))


def wallet_health(remain: Column, total: Column) -> Column:
    ratio = remain / F.greatest(total, F.lit(1.0))
    return first_match([(remain.isNull() | (F.coalesce(total, F.lit(0.0)) == 0), UNKNOWN), (ratio >= 0.5, "an_toan"),
                        (ratio >= 0.2, "can_than")], "bao_dong")


def trigger(amount: Column, threshold: Column, remain: Column, total: Column, frequency: Column) -> Column:
    """struct(is_triggered, type): any rule sets the flag, the first one names the type."""
    low = (F.coalesce(total, F.lit(0.0)) != 0) & (remain / F.greatest(total, F.lit(1.0)) < 0.2)
    kind = first_match([
        (F.coalesce(amount > threshold, F.lit(False)), "WARNING_AMOUNT"),
        (F.coalesce(amount > remain, F.lit(False)), "OVER_BUDGET"),
        (F.coalesce(low, F.lit(False)), "WARNING_BUDGET"),
        (F.coalesce(frequency > 3, F.lit(False)), "WARNING_FREQUENCY"),
    ])
    return F.struct(kind.isNotNull().alias("is_triggered"), kind.alias("type"))


def change_trigger(new: Column, old: Column) -> Column:
    """A new value at least half away from the old one."""
    far = F.abs(new - old) / F.greatest(old, F.lit(1)) >= 0.5
    return F.when(new.isNotNull() & (F.coalesce(old, F.lit(0)) != 0) & far, "WARNING_CHANGE")


def category_stat(stats: Column, category: Column, field: str) -> Column:
    """Value of the profile map for a category, 0 when absent."""
    return F.coalesce(F.try_element_at(stats, category)[field], F.lit(0))


def expense_facts(remain: Column, total: Column, pct: Column, frequency: Column, day: Column, category: Column) -> Column:
    """The first two facts that hold, as one text; NULL when none does."""
    ratio = remain / total
    has = (F.coalesce(total, F.lit(0.0)) > 0) & remain.isNotNull()
    money = F.format_number(remain, 0)
    payday = days_to_payday(day)
    facts = F.array_compact(F.array(
        F.when(has & (ratio < 0.2), F.concat(F.lit("Cảnh báo báo động: Ngân sách tháng này sắp cạn kiệt, chỉ còn lại "), money,
                                             F.lit("đ ("), F.format_string("%.1f", ratio * 100), F.lit("%).")))
        .when(has & (ratio < 0.5), F.concat(F.lit("Cảnh báo nhẹ: Ngân sách đã tiêu quá nửa, còn lại "), money, F.lit("đ."))),
        F.when(pct > 30, F.concat(F.lit("Danh mục "), category, F.lit(" đang chiếm tỷ trọng cực kỳ lớn: "),
                                  F.format_string("%.1f", pct), F.lit("% tổng chi tiêu cả tháng.")))
        .when(pct > 15, F.concat(F.lit("Danh mục "), category, F.lit(" chiếm tỷ trọng khá cao: "),
                                 F.format_string("%.1f", pct), F.lit("% tổng chi tiêu cả tháng."))),
        F.when(frequency > 4, F.concat(F.lit("Bạn đã chi cho "), category, F.lit(" tận "), frequency.cast("string"),
                                       F.lit(" lần chỉ trong tuần này."))),
        F.when(payday == 0, F.lit("Hôm nay là ngày nhận lương 💸."))
        .when(payday <= 3, F.concat(F.lit("Chỉ còn "), payday.cast("string"), F.lit(" ngày nữa là tới ngày nhận lương."))),
    ))
    return F.when(F.size(facts) > 0, F.array_join(F.slice(facts, 1, 2), " "))


def mentioned_fields(text: Column) -> Column:
    """Low-priority context fields the utterance speaks about."""
    low = F.lower(text)
    return F.array_join(F.array_compact(F.array(*[
        F.when(contains_any(low, words), F.lit(name)) for name, words in MENTIONS.items()])), ",")


def kept_groups(intent: Column, income: Column, health: Column, triggered: Column, record_type: Column, fact: Column,
                message: Column, action_facts: Column, action_type: Column) -> Column:
    """The two field groups of highest priority, as comma-separated names."""
    record, action = intent == "Record", intent == "Action"

    def group(cond: Column, score: int, order: int, name: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(-score).alias("s"), F.lit(order).alias("o"), F.lit(name).alias("n")))

    groups = F.array_sort(F.array_compact(F.array(
        group(triggered & ((record & ~income) | action), 2, 0, "trigger"),
        group(health.isNotNull() & (health != UNKNOWN) & (~record | ~income), 2, 1, "wallet_health"),
        group(record & record_type.isNotNull(), 2, 2, "record_type"),
        group(record & fact.isNotNull(), 1, 3, "historical_fact"),
        group(record & message.isNotNull(), 1, 4, "message_data"),
        group(action & action_facts.isNotNull(), 1, 5, "action_facts"),
        group(action & action_type.isNotNull(), 1, 6, "action_type"))))
    return F.array_join(F.transform(F.slice(groups, 1, 2), lambda g: g["n"]), ",")


def context_json(hour: Column, day: Column, remain: Column, total: Column, weather: Column) -> Column:
    """Display context of a profile row as JSON."""
    return F.to_json(F.struct(
        lookup(time_of_day(hour), TIME_LABELS).alias("time_of_day"),
        F.coalesce(weather, F.lit("nắng ấm")).alias("weather"),
        lookup(wallet_health(remain, total), HEALTH_LABELS).alias("wallet_health"),
        F.concat(days_to_payday(day).cast("string"), F.lit(" ngày nữa tới kỳ lương")).alias("days_to_payday")))
