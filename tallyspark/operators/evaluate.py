"""Evaluation tables: accuracy, confusion, per-class scores, latency, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.operators import scan

NO_CLASS = ["", "none", "null"]


def _pair_counts(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The data shrinks to one row per (keys, true, predicted) before anything else happens."""
    return pairs.groupBy(*keys, "label_true", "label_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("label_true") == F.col("label_pred")).cast("double")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(hit), 4).alias("accuracy"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Long confusion matrix over all labels seen on either side, zeros kept."""
    counts = _pair_counts(pairs)
    universe = counts.select(F.explode(F.array("label_true", "label_pred")).alias("l")).agg(F.collect_set("l").alias("u"))
    grid = universe.select(F.explode("u").alias("t"), "u").select("t", F.explode("u").alias("p"))
    hit = (F.col("t") == F.col("label_true")) & (F.col("p") == F.col("label_pred"))
    return grid.join(counts, hit, "left").select(
        F.col("t").alias("label_true"), F.col("p").alias("label_pred"), F.coalesce("n", F.lit(0)).alias("n"))


def _class_sums(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    same = F.col("label_true") == F.col("label_pred")
    parts = F.explode(F.array(
        F.struct(F.col("label_true").alias("c"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("label_pred").alias("c"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"))))
    long = counts.select(*keys, parts.alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, F.col("c").alias("label")).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def _scores(sums: DataFrame) -> DataFrame:
    """Precision, recall and F1 with 0 for an empty denominator."""
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return (sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
            .withColumn("recall", ratio(F.col("tp"), F.col("support")))
            .withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))))


def per_class(pairs: DataFrame) -> DataFrame:
    scored = _scores(_class_sums(_pair_counts(pairs)))
    return scored.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def averages(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy with macro and support-weighted precision, recall and F1, 4 decimals."""
    scored = _scores(_class_sums(_pair_counts(pairs, keys), keys))
    weighted = [F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 4).alias(f"weighted_{c}")
                for c in ("precision", "recall", "f1")]
    macro = [F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    return scored.groupBy(*keys).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.sum("support").alias("test_set"),
        *weighted, *macro)


def calc_metrics(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive accuracy and macro F1 over the real classes, in percent with 2 decimals."""
    low = pairs.withColumn("label_true", F.lower(F.trim("label_true"))).withColumn("label_pred", F.lower(F.trim("label_pred")))
    scored = _scores(_class_sums(_pair_counts(low, keys), keys))
    real = ~F.col("label").isin(NO_CLASS)
    acc = F.sum("tp") / F.sum("support")
    return scored.groupBy(*keys).agg(
        F.sum("support").alias("rows"), F.round(acc * 100, 2).alias("accuracy"),
        F.round(F.coalesce(F.avg(F.when(real, F.col("f1"))), acc) * 100, 2).alias("f1"))


def hierarchical_pairs(preds: DataFrame) -> DataFrame:
    """Long (task, true, predicted): a field counts where truth or prediction makes it applicable."""
    none = F.lit("None")

    def cat(col: Column) -> Column:
        return F.when(F.lower(F.trim(F.coalesce(col, none))).isin("null", "none", "", "nil"), none).otherwise(F.trim(col))

    ei, pi = F.col("exp_intent"), F.coalesce("pred_intent", F.lit("Unknown"))
    ea, pa = F.coalesce("exp_act", none), F.coalesce("pred_act", none)
    with_cat = rules.ACTIONS_WITH_CATEGORY
    exp_has = (ei == "Record") | ((ei == "Action") & ea.isin(with_cat))
    pred_has = (pi == "Record") | ((pi == "Action") & pa.isin(with_cat))

    def pair(task: str, applies: Column, true: Column, pred: Column) -> Column:
        return F.when(applies, F.struct(
            F.lit(task).alias("task"), true.alias("label_true"), pred.alias("label_pred")))

    def only(cond: Column, value: Column) -> Column:
        return F.when(cond, value).otherwise(none)

    pairs = F.array_compact(F.array(
        pair("intent", F.lit(True), ei, pi),
        pair("record_type", (ei == "Record") | (pi == "Record"),
             only(ei == "Record", F.coalesce("exp_rec", none)), only(pi == "Record", F.coalesce("pred_rec", none))),
        pair("category", exp_has | pred_has, only(exp_has, cat(F.col("exp_cat"))), only(pred_has, cat(F.col("pred_cat")))),
        pair("action_type", (ei == "Action") | (pi == "Action"), only(ei == "Action", ea), only(pi == "Action", pa))))
    return preds.select("row_id", F.explode(pairs).alias("p")).select("row_id", "p.*")


def eval_hierarchical(preds: DataFrame) -> DataFrame:
    return calc_metrics(hierarchical_pairs(preds), ["task"])


def around_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, edges: int = 64) -> DataFrame:
    """The values ``_lo`` and ``_hi`` on either side of a percentile, and the size ``_size`` of the group, for groups of any size.

    Approximate edges cut each group into ranges; range counts locate the two ranks that matter, and only
    the distinct values of their ranges are ranked.
    """
    steps = F.array(*[F.lit(i / edges) for i in range(1, edges)])
    rows = df.filter(F.col(value).isNotNull())
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, steps, F.lit(1000)).alias("_e"), F.count(F.lit(1)).alias("_size"))
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.join(cuts, list(keys)).withColumn(
        "_b", F.size(F.filter("_e", lambda e: e <= F.col(value)))).drop("_e")
    pos = (F.col("_size") - 1) * p
    ranges = placed.groupBy(*keys, "_b", "_size").agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    needed = ranges.filter((F.col("_before") <= F.ceil(pos)) & (F.col("_before") + F.col("_c") > F.floor(pos))).select(
        *keys, "_b", "_before")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(needed, [*keys, "_b"]).withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col(value)))

    return ranked.groupBy(*keys, "_size").agg(at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """Exact percentile with linear interpolation for groups of any size."""
    ends = around_percentile(df, keys, value, p)
    pos = (F.col("_size") - 1) * p
    share = pos - F.floor(pos)
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("percentile"))


def latency(df: DataFrame, key: str = "backend", value: str = "latency_ms", digits: int = 2) -> DataFrame:
    """Mean and 95th percentile per backend."""
    means = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(value), digits).alias("avg_latency_ms"))
    tail = exact_percentile(df, [key], value, 0.95)
    return means.join(tail, key).withColumn("p95_latency_ms", F.round("percentile", digits)).drop("percentile")


def eval_exact(preds: DataFrame) -> DataFrame:
    """Exact-match rate by the rule of the true intent, valid-JSON rate, mean of two macro F1s, in percent."""
    same = F.col("exp_intent") == F.col("pred_intent")
    cat = F.coalesce(F.when(F.col("pred_cat") != "", F.col("pred_cat")), F.lit("None"))
    rule = (F.when(F.col("exp_intent") == "Record",
                   (F.coalesce("exp_cat", F.lit("None")) == cat) & (F.col("exp_amount") == F.col("pred_amount")))
            .when(F.col("exp_intent") == "Action", F.coalesce("exp_act", F.lit("None")) == F.coalesce("pred_act", F.lit("None")))
            .otherwise(True))
    valid = F.size(F.json_object_keys("raw_json")) > 0
    rates = preds.agg(
        F.round(100 * F.avg(same.cast("double")), 2).alias("accuracy"),
        F.round(100 * F.avg((same & rule).cast("double")), 2).alias("exact_match"),
        F.round(100 * F.avg(F.coalesce(valid, F.lit(False)).cast("double")), 2).alias("json_valid"))
    tasks = F.explode(F.array_compact(F.array(
        F.struct(F.lit("intent").alias("task"), F.col("exp_intent").alias("label_true"), F.col("pred_intent").alias("label_pred")),
        F.when(F.col("exp_intent") == "Record", F.struct(
            F.lit("category").alias("task"), F.coalesce("exp_cat", F.lit("None")).alias("label_true"), cat.alias("label_pred"))))))
    long = preds.select(tasks.alias("p")).select("p.*")
    macro = _scores(_class_sums(_pair_counts(long, ["task"]), ["task"])).groupBy("task").agg(F.avg("f1").alias("m"))
    f1 = macro.agg(F.round(100 * (F.sum("m") + F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(0.0)) / 2, 2).alias("f1"))
    return rates.join(F.broadcast(f1))  # one row on each side


def golden_eval(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Amount and category accuracy over fixtures and whether both pass.

    ``predicted``: fixture_id, amount, category, seller; ``expected``: fixture_id, amount, category, seller_contains.
    """
    exp = expected.select("fixture_id", F.col("amount").alias("ea"), F.col("category").alias("ec"),
                          F.col("seller_contains").alias("es"))
    wanted = F.coalesce("es", F.lit("")) == ""
    rows = exp.join(predicted, "fixture_id", "left").select(
        F.col("amount").eqNullSafe(F.col("ea")).cast("double").alias("a"),
        F.col("category").eqNullSafe(F.col("ec")).cast("double").alias("c"),
        (wanted | F.contains(F.lower(F.coalesce("seller", F.lit(""))), F.lower(F.coalesce("es", F.lit(""))))).cast("double").alias("s"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("a"), F.lit(0.0)).alias("a"),
                   F.coalesce(F.avg("c"), F.lit(0.0)).alias("c"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("s"))
    return out.select("n", F.round("a", 4).alias("amount_acc"), F.round("c", 4).alias("category_acc"),
                      F.round("s", 4).alias("seller_acc"),
                      ((F.col("n") > 0) & (F.col("a") >= 0.85) & (F.col("c") >= 0.80)).alias("pass"))


def entity_chunks(tokens: DataFrame, tag: str, doc: str = "receipt_id", pos: str = "pos", width: int | None = None) -> DataFrame:
    """Entity spans (doc, start, end, type) of IOB tags; a chunk starts on B or where the type changes."""
    kind = F.when(F.col(tag) != "O", F.substring(tag, 3, 100))
    rows = tokens.select(doc, pos, F.col(tag).alias("_tag"), kind.alias("_kind"))
    rows = scan.lag_value(rows, doc, [pos], "_kind", "_last_kind", width)
    starts = F.col("_kind").isNotNull() & (F.col("_tag").startswith("B-") | ~F.col("_kind").eqNullSafe(F.col("_last_kind")))
    rows = scan.running_sum(rows, doc, [pos], starts.cast("bigint"), "_chunk", width)
    return rows.filter("_kind IS NOT NULL").groupBy(doc, "_chunk").agg(
        F.min(pos).alias("start"), F.max(pos).alias("end"), F.first("_kind").alias("type")).drop("_chunk")


def entity_scores(tokens: DataFrame, true: str = "tag_true", pred: str = "tag_pred", doc: str = "receipt_id",
                  width: int | None = None) -> DataFrame:
    """Entity-level precision, recall and F1 per type plus micro, macro and weighted rows."""
    keys = [doc, "start", "end", "type"]
    gold = entity_chunks(tokens, true, doc, width=width).withColumn("g", F.lit(1))
    found = entity_chunks(tokens, pred, doc, width=width).withColumn("p", F.lit(1))
    both = gold.join(found, keys, "full_outer")
    sums = both.groupBy(F.col("type").alias("label")).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("g").alias("support"),
        F.count("p").alias("predicted"))
    scored = _scores(sums).select("label", "precision", "recall", "f1", "support")
    micro = _scores(sums.agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                             F.sum("predicted").alias("predicted"))).select(
        F.lit("micro").alias("label"), "precision", "recall", "f1", "support")
    macro = scored.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = scored.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
                            for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    out = (scored.unionByName(micro).unionByName(macro.withColumn("label", F.lit("macro")))
           .unionByName(weighted.withColumn("label", F.lit("weighted"))))
    return out.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def regression_report(preds: DataFrame, cases: DataFrame) -> DataFrame:
    """Failed cases with one message per wrong field. NULL expectations of category and type are not checked."""
    exp = cases.select("row_id", "tag", F.col("intent").alias("ei"), F.col("category").alias("ec"), F.col("record_type").alias("er"))
    rows = exp.join(preds.select("row_id", "intent", "category", "record_type"), "row_id", "left")

    def error(name: str, got: str, want: str, optional: bool) -> Column:
        wrong = ~F.col(got).eqNullSafe(F.col(want))
        if optional:
            wrong = wrong & (F.coalesce(F.col(want), F.lit("")) != "")
        return F.when(wrong, F.concat(F.lit(f"{name}="), F.coalesce(got, F.lit("None")), F.lit("!="), F.coalesce(want, F.lit("None"))))

    errors = F.array_compact(F.array(error("intent", "intent", "ei", False), error("category", "category", "ec", True),
                                     error("record_type", "record_type", "er", True)))
    return rows.select("row_id", "tag", F.array_join(errors, ", ").alias("errors")).filter("errors <> ''")


def failed_tags(report: DataFrame) -> DataFrame:
    return report.groupBy("tag").agg(F.count(F.lit(1)).alias("failed"))


def headline_f1(weighted_f1: Column, accuracy_: Column) -> Column:
    """Weighted F1, else accuracy, as percent text with one decimal."""
    raw = F.coalesce(weighted_f1, accuracy_)
    return F.format_string("%.1f", F.when(raw <= 1, raw * 100).otherwise(raw))


def history(runs: DataFrame, keep: int = 100) -> DataFrame:
    """The last ``keep`` runs with their running number and headline score.

    Running numbers come from the run count and the position among the kept runs.
    """
    total = runs.agg(F.count(F.lit(1)).alias("_total"))
    last = runs.orderBy(F.desc("trained_at"), F.desc("run_id")).limit(keep)
    recent = Window.partitionBy(F.lit(1)).orderBy(F.desc("trained_at"), F.desc("run_id"))  # at most ``keep`` rows
    rows = last.withColumn("_r", F.row_number().over(recent)).join(F.broadcast(total))  # one-row side
    return rows.select("run_id", (F.col("_total") - F.col("_r") + 1).alias("run_index"), "status",
                       F.when(F.col("status") == "success", headline_f1(F.col("weighted_f1"), F.col("accuracy"))).alias("f1_score"))
