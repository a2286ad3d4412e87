"""Slots of an action: amount span, exact text, then models that depend on the action (M6)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import money
from tallyspark.functions import text as tx
from tallyspark.operators.dedupe import keep_first
from tallyspark.operators.ml import class_weights, ngrams
from tallyspark.operators.ordering import dealt, repeated
from tallyspark.session import kept

#: Hashed features of all blocks together; with the classes it bounds the size of the model.
FEATURES = 1 << 14
#: A field with more values than this is looked up by its text only.
MAX_CLASSES = 64
#: Fields of a prediction, in the order of the result.
DETAILS = ["verb", "target", "target_type", "goal_name", "tool_type", "loan_type", "contact_name", "due_date",
           "value", "unit", "time", "enabled", "theme", "verbal_style", "query", "note"]
#: Actions that ask for a value or a verb beside their own fields, and what their target is.
VALUE_ACTIONS = ["SET_LIMIT", "SET_GOAL", "ADD_GOAL", "SET_INCOME", "SET_USERNAME"]
VERB_ACTIONS = ["ADD_GOAL", "SET_LIMIT"]
TARGET_TYPES = {"SET_LIMIT": "LIMIT", "SET_GOAL": "GOAL", "ADD_GOAL": "GOAL"}


@dataclass
class SlotModel:
    """``exact`` (field, text, value), the classes of each field, one classifier for all fields, one regression for amounts."""

    exact: DataFrame
    classes: dict[str, list[str]]
    classifier: PipelineModel | None
    amounts: PipelineModel | None


def action_name(action: Column) -> Column:
    name = F.upper(F.coalesce(action, F.lit("")))
    return F.when(name == "SETTING", "SYSTEM_SETTING").otherwise(name)


def asked_fields(action: Column) -> Column:
    """Fields of an action, ``value`` among them where it takes one."""
    table = {a: sorted({*f, *(["value"] if a in VALUE_ACTIONS else []), *(["verb"] if a in VERB_ACTIONS else [])}) for a, f in rules.SLOTS_BY_ACTION.items()}
    table |= {a: ["value"] for a in VALUE_ACTIONS if a not in table}
    pairs = [x for a, f in table.items() for x in (F.lit(a), F.array(*map(F.lit, f)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), action), F.array().cast("array<string>"))


def labelled_slots(train: DataFrame) -> DataFrame:
    """One row per filled slot: ``row_id``, ``text``, ``action``, ``field``, ``value``; values that are no numbers are ``value_text``."""
    columns = [c for c in rules.SLOT_COLUMNS if c in train.columns]
    filled = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), tx.blank_to_null(F.col(c)).alias("value")) for c in columns]), lambda s: s["value"].isNotNull())
    rows = train.select("row_id", "text", action_name(F.col("action_type")).alias("action"), F.explode(filled).alias("s")).select("row_id", "text", "action", "s.*")
    worded = (F.col("field") == "value") & F.col("value").try_cast("double").isNull()
    return rows.withColumn("field", F.when(worded, "value_text").otherwise(F.col("field")))


def _blocks(rows: DataFrame) -> DataFrame:
    """Grams of the text in two blocks: one of the field, one of the field under the action."""
    rows = tx.let(rows, _g=ngrams(tx.letter_tokens(F.col("text"))))
    own = F.transform("_g", lambda g: F.concat_ws("|", "field", g))
    under = F.transform("_g", lambda g: F.concat_ws("|", "field", "action", g))
    return rows.withColumn("grams", F.concat(own, under, F.array(F.col("field"), F.concat_ws("|", "field", "action")))).drop("_g")


def _features() -> list:
    return [HashingTF(inputCol="grams", outputCol="tf", numFeatures=FEATURES), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")]


def _fitted(made: DataFrame, fit, balanced: bool = False) -> PipelineModel:
    """Features and model from different rows (``grams``, ``y``) and how often each stands (``n``).

    Features are made once per different row, the fits see every row: document frequencies and losses are those of all.
    """
    tf, idf, unit = _features()
    counted = kept(tf.transform(made).drop("grams"), "slot-tf")
    weighed = idf.fit(repeated(counted, "n"))
    rows = repeated(kept(unit.transform(weighed.transform(counted)).select("features", "y", "n"), "slot-features"), "n")
    return PipelineModel([tf, weighed, unit, fit.fit(class_weights(rows, "y") if balanced else rows)])


def fit_slots(train: DataFrame, iterations: int = 30) -> SlotModel:
    """Models from rows of ``row_id``, ``text``, ``action_type`` and slot columns.

    All fields share one feature table with a row per filled slot and one fit: grams stand in a block of their field and
    once more in a block of field and action, so weights depend on the action and a field without enough rows under one
    action leans on the others. The classes are the pairs of field and value; only those of the asked field compete later.
    """
    same = ["text", "action", "field", "value"]
    cells = kept(labelled_slots(train).groupBy(*same).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")), "slots")
    exact = keep_first(cells, F.struct("field", "text"), "row_id").select("field", "text", "value")
    sizes = cells.filter("field <> 'value'").select("field", "value").distinct().groupBy("field").count()
    closed = [r.field for r in sizes.filter(F.col("count") <= MAX_CLASSES).collect()]
    pairs = cells.filter(F.col("field").isin(closed)).select("field", "value").distinct().collect()  # MAX_CLASSES per field
    classes = {f: sorted(v for g, v in pairs if g == f) for f in sorted(closed)}
    order = [(f, v) for f, values in classes.items() for v in values]
    classifier = amounts = None
    if len(order) > 1:
        numbers = cells.sparkSession.createDataFrame([(f, v, float(k)) for k, (f, v) in enumerate(order)], "field STRING, value STRING, y DOUBLE")
        made = kept(_blocks(cells.join(F.broadcast(numbers), ["field", "value"])).select("grams", "y", "n"), "slot-grams")
        fit = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", maxIter=iterations, regParam=0.0005)
        classifier = _fitted(made, fit, balanced=True)
    known = cells.filter("field = 'value'").withColumn("y", F.log1p(F.col("value").try_cast("double"))).filter("y IS NOT NULL AND NOT isnan(y)")
    if known.head() is not None:
        made = kept(_blocks(known).select("grams", "y", "n"), "amount-grams")
        amounts = _fitted(made, LinearRegression(labelCol="y", regParam=0.01, maxIter=iterations))
    return SlotModel(exact, classes, classifier, amounts)


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "text", action_name(F.col("action_type")).alias("action")).withColumn("field", F.explode(asked_fields(F.col("action"))))


def exact_slots(rows: DataFrame, model: SlotModel) -> DataFrame:
    """``row_id``, ``field``, ``value`` of the asked fields that a training row of the same text fills."""
    return _asked(rows).join(model.exact, ["field", "text"]).select("row_id", "field", "value")


def _guessed(asked: DataFrame, model: SlotModel) -> DataFrame:
    """The classifier's value of every asked field it knows."""
    if model.classifier is None:
        return asked.sparkSession.createDataFrame([], "row_id BIGINT, field STRING, value STRING")
    order = [(f, v) for f, values in model.classes.items() for v in values]
    starts = {f: next(i for i, pair in enumerate(order) if pair[0] == f) for f in model.classes}
    spans = F.create_map(*[x for f, values in model.classes.items() for x in (F.lit(f), F.struct(F.lit(starts[f] + 1).alias("at"), F.lit(len(values)).alias("n")))])
    scored = model.classifier.transform(_blocks(asked.filter(F.col("field").isin(list(model.classes)))))
    scored = scored.select("row_id", "field", vector_to_array("probability").alias("p"), F.element_at(spans, F.col("field")).alias("s"))
    mine = F.slice("p", F.col("s.at"), F.col("s.n"))
    place = F.col("s.at") + F.array_position(mine, F.array_max(mine)) - 2
    return scored.select("row_id", "field", F.get(F.array(*[F.lit(v) for _, v in order]), place.cast("int")).alias("value"))


def predict_slots(rows: DataFrame, model: SlotModel) -> DataFrame:
    """``row_id``, ``action`` and the ``DETAILS`` of rows of ``row_id`` (unique), ``text``, ``action_type``, ``amount_span``.

    Only the fields of the action are filled: from a training row of the same text, else by the classifier among the
    field's values. A goal is also the target; a category is the target; a time range becomes the list of times. The value
    comes from the amount span if it has an amount, else from a training row, else from the regression on the log
    scale; a user name falls back to the known names. ``amount_span`` may be null. Rows that agree in text, action and
    amount span get one prediction, joined back.
    """
    given = ["text", "action_type", "amount_span"]
    asked = kept(rows.select(*given).distinct().withColumn("row_id", F.monotonically_increasing_id()), "asked")
    found = kept(_predicted(dealt(asked), model), "asked-slots").withColumnRenamed("row_id", "_q")
    numbered = asked.select(F.col("row_id").alias("_q"), *[F.col(c).alias(f"_{c}") for c in given])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in given]
    return rows.select("row_id", *given).join(numbered.join(found, "_q"), reduce(and_, same)).select("row_id", "action", *DETAILS)


def _predicted(rows: DataFrame, model: SlotModel) -> DataFrame:
    """``predict_slots`` of rows that all differ."""
    asked = _asked(rows)
    exact = asked.join(model.exact, ["field", "text"]).select("row_id", "field", F.col("value").alias("_exact"))
    guessed = _guessed(asked, model)
    names = _guessed(rows.select("row_id", "text", action_name(F.col("action_type")).alias("action")).filter("action = 'SET_USERNAME'").withColumn(
        "field", F.lit("value_text")), model)
    if model.amounts is None:
        numbers = rows.sparkSession.createDataFrame([], "row_id BIGINT, field STRING, value STRING")
    else:
        numbers = model.amounts.transform(_blocks(asked.filter("field = 'value'"))).select(
            "row_id", "field", F.bround(F.expm1("prediction")).cast("bigint").cast("string").alias("value"))
    parts = [exact.select("row_id", "field", F.lit(1).alias("o"), F.col("_exact").alias("value")),
             guessed.select("row_id", "field", F.lit(2).alias("o"), "value"), numbers.select("row_id", "field", F.lit(3).alias("o"), "value"),
             names.select("row_id", F.lit("value").alias("field"), F.lit(4).alias("o"), "value")]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.filter("value IS NOT NULL").groupBy("row_id", "field").agg(F.min_by("value", "o").alias("value"))
    slot = best.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("slot"))  # a value per field of the action
    joined = rows.select("row_id", action_name(F.col("action_type")).alias("action"), "amount_span").join(slot, "row_id", "left")
    got = lambda f: F.try_element_at("slot", F.lit(f))
    span = F.get(money.extract_amounts(F.col("amount_span")), F.lit(0)).cast("string")
    value = F.when(F.array_contains(asked_fields(F.col("action")), "value"), F.coalesce(span, got("value")))
    made = {"target": F.coalesce(got("goal_name"), got("category_code")), "target_type": tx.lookup(F.col("action"), TARGET_TYPES), "value": value,
            "unit": F.when(value.isNotNull(), "VND"), "time": F.when(got("time_range").isNotNull(), F.array(got("time_range")))}
    return joined.select("row_id", "action", *[made.get(d, got(d)).alias(d) for d in DETAILS])
