"""Model answers and log payloads: parsing, defaults, forced values."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyspark import rules
from tallyspark.functions.text import contains_any, first_match

# Workers need not have the package installed: its few Python helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _balanced(text: str) -> str | None:
    """The first complete {...} block, quotes and escapes respected."""
    start, depth, quoted, i = text.find("{"), 0, False, 0
    if start < 0:
        return None
    i = start
    while i < len(text):
        c = text[i]
        if quoted and c == "\\":
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start:i + 1]
        i += 1
    return None


def _closed(text: str) -> str:
    """Truncated JSON with its string and braces closed."""
    text = text.strip()
    if text.startswith("{") and not text.endswith("}"):
        text += '"' if text.count('"') % 2 else ""
        text += "}" * max(0, text.count("{") - text.count("}"))
    return text


def _salvage(text: str | None) -> str | None:
    if text is None:
        return None
    block = _balanced(text)
    for candidate in ([block] if block else []) + [_closed(text)]:
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _salvage_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_salvage)


def parse_model_json(col: Column) -> Column:
    """JSON text of a model answer: fences dropped, strict parse first, the scan only for what is left."""
    text = F.trim(col)
    bare = F.when(text.startswith("```"), F.regexp_replace(text, r"(?m)^\s*```.*$\n?", "")).otherwise(text)
    valid = F.try_parse_json(bare).isNotNull()
    return F.when(valid, bare).otherwise(_salvage_batch(F.when(~F.coalesce(valid, F.lit(False)), bare)))


PAYLOAD = ("intent STRING, action_type STRING, slots MAP<STRING,STRING>, suggested_actions ARRAY<STRING>, emotion STRING, "
           "response STRING, contextMeta STRING, record_type STRING, category STRING, amount STRING, corrected_intent STRING")


def missing_slots(action: Column, slots: dict[str, Column], loan: Column) -> Column:
    """Required slots without a value; a loan goal needs two more."""
    def empty(name: str) -> Column:
        return F.coalesce(slots[name] == "", F.lit(True)) if name in slots else F.lit(True)

    needed = [F.when((action == a) & empty(s), F.lit(s)) for a, names in rules.MISSING_CHECK.items() for s in names]
    needed += [F.when((action == "SET_GOAL") & F.coalesce(loan, F.lit(False)) & empty(s), F.lit(s)) for s in rules.LOAN_FIELDS]
    return F.array_join(F.array_compact(F.array(*needed)), ",")


def fallback_record_type(top: Column, slot: Column) -> Column:
    return F.when(top.isin("Income", "Expense"), top).otherwise(
        F.when(F.lower(F.trim(slot)) == "income", "Income").otherwise("Expense"))


def fallback_action(intent: Column, action: Column, text: Column) -> Column:
    report = contains_any(F.lower(F.trim(text)), rules.REPORT_WORDS)
    guess = F.when(report, "REPORT_GENERAL").otherwise("SEARCH_RECORD")
    return F.when(intent == "Action", F.coalesce(F.when(action != "", action), guess))


def merge_forced(parsed: Column, text: Column, forced_category: Column, forced_type: Column, intent: Column) -> list[Column]:
    """Result columns; forced values win over the top level, the top level over slots, slots over defaults."""
    def filled(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    slots = parsed["slots"]
    kind = F.coalesce(filled(forced_type), parsed["record_type"])
    kind = F.when(kind.isin("Income", "Expense"), kind).otherwise("Expense")
    return [
        F.coalesce(filled(forced_category), filled(parsed["category"]), slots["category"]).alias("category"),
        F.coalesce(filled(parsed["amount"]), filled(slots["amount"]), filled(slots["value"]), F.lit("0")).alias("amount"),
        F.when(intent == "Record", kind).alias("record_type"), slots["item"].alias("item"),
        F.coalesce(filled(parsed["emotion"]), F.lit("neutral")).alias("emotion"), text.alias("text"),
        first_match([(parsed["suggested_actions"].isNotNull(), F.array_join(parsed["suggested_actions"], "|")),
                     (intent == "Chitchat", "Ghi chép|Quét bill|Xem báo cáo")]).alias("suggested_actions"),
    ]
