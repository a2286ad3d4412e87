"""The whole result row of an utterance: models and corrections first, then one set of rules (M9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import money, timeparse
from tallyspark.functions import text as tx
from tallyspark.operators import slots as slot_ops
from tallyspark.operators.baseline import longest_span, multi_records
from tallyspark.operators.curate import canon_intent
from tallyspark.operators.ml import predict
from tallyspark.operators.ordering import dealt
from tallyspark.operators.similarity import GramWeights, similar_corrections
from tallyspark.session import kept

INCOME_TYPES = ["salary", "bonus", "investment", "business"]
#: Columns that the rules read: what the models and the user's correction say.
PREDICTED = ["intent_pred", "intent_prob", "record_type_pred", "category_pred", "category_item", "action_type_pred",
             "match_type", "match_score", "match_intent", "match_category", "match_record_type"]


@dataclass
class Models:
    """Fitted classifiers; ``weights`` are the corpus weights that corrections are compared by."""

    intent: PipelineModel
    record_type: PipelineModel
    category: PipelineModel
    action_type: PipelineModel
    slots: slot_ops.SlotModel
    weights: GramWeights


def _label(model: PipelineModel, rows: DataFrame, text: Column, out: str) -> DataFrame:
    return predict(model, rows, text, out).drop("confidence", "distribution")


def predicted(rows: DataFrame, models: Models, corrections: DataFrame | None = None) -> DataFrame:
    """``rows`` (row_id, user_id, text, item_spans) with the ``PREDICTED`` columns, ``item`` and without spans.

    The models see every different text and item once; what they say is joined back.
    ``corrections`` has correction_id, user_id, text, intent, category_code, record_type.
    """
    text = F.col("text")
    said = rows.withColumn("item", longest_span(F.col("item_spans"))).drop("item_spans")
    asked = kept(said.select("text", "item").distinct(), "asked")
    out = predict(models.intent, dealt(asked), text, "intent_pred")
    out = out.withColumnRenamed("confidence", "intent_prob").drop("distribution")
    out = _label(models.record_type, out, tx.clean_category_text(text), "record_type_pred")
    out = _label(models.category, out, tx.clean_category_text(text), "category_pred")
    out = _label(models.category, out, F.coalesce("item", F.lit("")), "category_item")
    out = out.withColumn("category_item", F.when(F.col("item").isNotNull(), F.col("category_item")))
    out = kept(_label(models.action_type, out, text, "action_type_pred"), "asked-labels")
    out = said.join(out.withColumnsRenamed({"text": "_text", "item": "_item"}), F.col("text").eqNullSafe(F.col("_text")) & F.col("item").eqNullSafe(F.col("_item"))).drop("_text", "_item")
    empty = ["match_type", "match_intent", "match_category", "match_record_type"]
    if corrections is None:
        return out.withColumns({**{c: F.lit(None).cast("string") for c in empty}, "match_score": F.lit(None).cast("double")})
    found = similar_corrections(rows, corrections, models.weights).join(corrections.select(
        "correction_id", F.col("intent").alias("match_intent"), F.col("category_code").alias("match_category"), F.col("record_type").alias("match_record_type")), "correction_id")
    found = found.select("row_id", "match_type", F.col("score").alias("match_score"), *empty[1:])
    return out.join(found, "row_id", "left")


def decided(rows: DataFrame) -> DataFrame:
    """Intent, type, category, item and amounts of rows with the ``PREDICTED`` columns, ``text`` and ``item``.

    A correction's intent, record type and category go before the models'. Of the category of the whole sentence and that
    of the item, the sentence's counts where they differ. What does not belong to the intent is null.
    """
    user = F.concat(F.lit("user_"), F.col("match_type"))
    fixed = F.when(F.col("match_type").isNotNull() & (F.coalesce("match_intent", F.lit("")) != ""), canon_intent(F.col("match_intent"), "Record"))
    intent = F.coalesce(fixed, "intent_pred")
    out = tx.let(rows, _intent=intent, _amounts=money.extract_amounts(F.col("text")), _content=money.clean_content(F.col("text")))
    record, action = F.col("_intent") == "Record", F.col("_intent") == "Action"
    typed = F.coalesce(F.nullif("match_record_type", F.lit("")))
    kind = F.when(typed.isNotNull(), tx.lookup(F.lower(tx.strip(typed)), rules.TYPE_ALIASES, typed)).otherwise(
        F.when(F.lower("record_type_pred") == "income", "Income").when(F.col("record_type_pred").isNotNull(), "Expense"))
    given = F.nullif("match_category", F.lit(""))
    raw = F.coalesce(given, "category_pred")
    same = F.lower(raw) == F.lower("category_item")
    category = F.when(raw.isNotNull() & F.col("category_item").isNotNull() & ~same, raw).otherwise(F.coalesce("category_item", raw))
    out = tx.let(out, _kind=F.when(record, kind), _category=F.when(record, category))
    low, first = F.lower(tx.strip(F.col("_category"))), F.get("_amounts", F.lit(0))
    backend = lambda there: F.when(record, F.when(there, user).otherwise("tfidf"))
    return out.select(
        "row_id", "text", F.col("_intent").alias("intent"), F.when(fixed.isNotNull(), F.col("match_score")).otherwise(F.col("intent_prob")).alias("intent_confidence"),
        F.when(fixed.isNotNull(), user).otherwise("tfidf").alias("intent_backend"), F.col("_content").alias("clean_content"),
        F.when(record, first).alias("amount_spent"), F.col("_kind").alias("record_type"), backend(typed.isNotNull()).alias("record_type_backend"),
        F.when((F.col("_kind") == "Income") & low.isin(INCOME_TYPES), low).alias("income_type"), F.when(record, F.col("item")).alias("item"),
        F.col("_category").alias("category"), backend(given.isNotNull()).alias("category_backend"), F.when(record, F.col("category_item")).alias("category_ner"),
        (F.lower("_category") == F.lower(F.when(record, F.col("category_item")))).alias("category_agreement"),
        F.when(action, F.col("action_type_pred")).alias("action_type"), F.when(action, first).alias("action_param"))


def understand(rows: DataFrame, models: Models, corrections: DataFrame | None = None) -> DataFrame:
    """The result rows of ``rows`` (row_id unique, user_id, text, ts, item_spans, amount_span).

    Beside the fields of ``decided``: ``multi_records`` and ``multi_record_task`` of records with several amounts, each with
    its own category and type, and ``action_details`` and ``time_range`` (from the time slot, else the text) of actions.
    What the models say and what is decided is written once; three branches read it.
    """
    said = kept(predicted(rows.select("row_id", "user_id", "text", "item_spans"), models, corrections), "predicted")
    out = kept(decided(dealt(said)), "decided")
    parts = multi_records(out.filter("intent = 'Record'").select("row_id", "text"))
    parts = _label(models.category, parts, tx.clean_category_text(F.col("segment")), "category")
    parts = _label(models.record_type, parts, tx.clean_category_text(F.col("segment")), "_kind")
    kind = F.when(F.lower("_kind") == "income", "Income").otherwise("Expense")
    listed = F.array_sort(F.collect_list(F.struct("pos", "segment", "item", "amount", "category", kind.alias("record_type"))))
    multi = parts.groupBy("row_id").agg(listed.alias("multi_records"))  # the segments of one text
    asked = out.filter("intent = 'Action'").select("row_id", "text", F.col("action_type")).join(rows.select("row_id", "amount_span", "ts"), "row_id")
    details = slot_ops.predict_slots(asked.select("row_id", "text", "action_type", "amount_span"), models.slots)
    details = details.select("row_id", F.struct(*slot_ops.DETAILS).alias("action_details"))
    timed = asked.join(details, "row_id").withColumn("_said", F.coalesce(F.get("action_details.time", F.lit(0)), "text"))
    timed = timeparse.with_time_range(timed, F.col("_said"), F.col("ts"), "time_range").select("row_id", "action_details", "time_range")
    whole = out.join(multi, "row_id", "left").join(timed, "row_id", "left")
    return whole.withColumn("multi_record_task", F.coalesce(F.size("multi_records") >= 2, F.lit(False)))
