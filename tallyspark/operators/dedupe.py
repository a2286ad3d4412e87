"""Deduplication, appends, upserts and feedback merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as tx
from tallyspark.operators.curate import canon_intent, split_action_like
from tallyspark.operators.ordering import keep_first


def dedupe_exact(df: DataFrame, column: str = "text") -> DataFrame:
    return keep_first(df, column)


def dedupe_masked(df: DataFrame) -> DataFrame:
    """Exact duplicates go first, then texts that differ only by their amounts."""
    return keep_first(dedupe_exact(df), tx.mask_amounts(F.col("text")))


def dedupe_folded(df: DataFrame, column: str = "text") -> DataFrame:
    return keep_first(df, tx.collapse_ws(tx.fold_marks(F.col(column))))


def dedupe_ci(df: DataFrame, column: str = "text") -> DataFrame:
    return keep_first(df, F.lower(tx.strip(F.col(column))))


def dedupe_spans(df: DataFrame) -> DataFrame:
    return keep_first(df, tx.strip(F.col("text")))


def dedupe_mode(df: DataFrame, text: str, first: str, modes: Sequence[str]) -> DataFrame:
    """One row per text: the first non-null value of one column and the smallest most frequent of the others.

    Counts per (text, value) come first, so a text with many copies is summed map-side.
    """
    head = df.groupBy(text).agg(F.min_by(first, F.when(F.col(first).isNotNull(), F.col("row_id"))).alias(first))
    out = head
    for column in modes:
        counts = df.filter(F.col(column).isNotNull()).groupBy(text, column).agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy(text).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_b"))
        best = best.select(F.col(text).alias("_t"), F.col("_b.v").alias(column))
        out = out.join(best, F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")
    return out


def append_new(base: DataFrame, batch: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows of ``batch`` whose trimmed text is new, first one per text."""
    key = tx.strip(F.col("text")) if key is None else key
    seen = base.select(key.alias("_seen")).filter("_seen IS NOT NULL").distinct()
    fresh = keep_first(batch.withColumn("_k", key).filter(F.coalesce(F.col("_k"), F.lit("")) != ""), "_k")
    return fresh.join(seen, F.col("_k") == F.col("_seen"), "left_anti").drop("_k")


def append_new_masked(base: DataFrame, batch: DataFrame) -> DataFrame:
    """New by exact text and by amount-masked text, also inside the batch."""
    fresh = append_new(base, batch)
    return append_new(base, fresh, tx.mask_amounts(F.col("text")))


def minus(df: DataFrame, blocked: DataFrame, column: str = "text") -> DataFrame:
    keys = blocked.select(F.col(column).alias("_blocked")).distinct()
    return df.join(keys, F.col(column) == F.col("_blocked"), "left_anti")


def rewrite_by_position(df: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and ``new`` pair up by row_id; texts of ``df`` equal to an old text take the new one.

    When one old text was rewritten more than once, the last pair wins.
    """
    pairs = (old.select("row_id", tx.strip(F.col("text")).alias("_old"))
             .join(new.select("row_id", tx.strip(F.col("text")).alias("_new")), "row_id")
             .filter((F.col("_old") != "") & (F.col("_old") != F.col("_new"))))
    table = keep_first(pairs, "_old", [F.desc("row_id")]).drop("row_id")
    joined = df.join(table, tx.strip(F.col("text")) == F.col("_old"), "left")
    return joined.withColumn("text", F.coalesce("_new", "text")).drop("_old", "_new")


def dislike_corrections(log: DataFrame) -> DataFrame:
    """Usable corrections: first dislike per text, own categories dropped, intent canonicalised."""
    payload = F.from_json(
        "payload", "intent_disliked BOOLEAN, corrected_intent STRING, corrected_category STRING")
    rows = log.filter((F.col("log_type") == "dislike") & (F.coalesce(tx.strip(F.col("text_input")), F.lit("")) != ""))
    rows = keep_first(rows.withColumn("text_key", F.lower(tx.strip(F.col("text_input")))), "text_key")
    category = F.col("p.corrected_category")
    rows = rows.withColumn("p", payload).filter("p.intent_disliked").select(
        "row_id", "text_key", "text_input", canon_intent(F.col("p.corrected_intent")).alias("new_intent"),
        F.when(category.startswith("cat_"), category).alias("new_category"))
    return rows.filter("new_intent IS NOT NULL OR new_category IS NOT NULL").withColumn(
        "target", F.when(F.col("new_intent").isin("Record", "Action", "Chitchat"), F.col("new_intent")).otherwise("Record"))


def merge_feedback(corpus: DataFrame, log: DataFrame) -> DataFrame:
    """Corpus after corrections: update in place, move to another intent table, or insert.

    ``corpus`` has row_id, text, intent (its table) and category_code. Of the tables that hold a text only the first
    (Record, Action, Chitchat) is touched. A row that moves keeps its data, and only its first copy moves.
    """
    fixes = dislike_corrections(log).drop("row_id")
    place = F.coalesce(F.nullif(F.array_position(F.array(F.lit("Record"), F.lit("Action"), F.lit("Chitchat")), F.col("intent")), F.lit(0)), F.lit(4))
    base = corpus.withColumn("text_key", F.lower(tx.strip(F.col("text")))).withColumn("_place", place)
    first = base.join(fixes.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.min("_place").alias("_place"))
    hit = base.join(fixes.join(first, "text_key"), ["text_key", "_place"], "left").drop("_place")
    moved = F.col("target").isNotNull() & (F.col("intent") != F.col("target"))
    updated = hit.withColumn("op", F.when(F.col("target").isNull(), "keep").when(moved, "move").otherwise("update"))
    copies = updated.filter("op = 'move'")
    settled = updated.filter("op <> 'move'").unionByName(keep_first(copies, "text_key"))
    settled = settled.select(
        "row_id", "text", F.coalesce("target", "intent").alias("intent"),
        F.coalesce("new_category", "category_code").alias("category_code"), "op")
    known = base.select("text_key").distinct()
    added = fixes.join(known, "text_key", "left_anti").select(
        F.lit(None).cast("bigint").alias("row_id"), F.col("text_input").alias("text"), F.col("target").alias("intent"),
        F.coalesce("new_category", F.lit("")).alias("category_code"), F.lit("insert").alias("op"))
    return settled.unionByName(added)


def match_correction(log: DataFrame, corrections: DataFrame) -> DataFrame:
    """First correction of the same user whose cleaned text equals the cleaned input."""
    key = tx.clean_category_text(F.col("text"))
    table = keep_first(corrections.withColumn("_ck", key), F.struct("user_id", "_ck"), "correction_id")
    table = table.select(F.col("user_id").alias("_user"), "_ck", "correction_id", "category_code", "record_type",
                         canon_intent(F.col("intent"), "Record").alias("intent"))
    rows = log.select("row_id", "user_id", tx.clean_category_text(F.col("text_input")).alias("_k"))
    return rows.join(table, (F.col("user_id") == F.col("_user")) & (F.col("_k") == F.col("_ck"))).select(
        "row_id", "user_id", "correction_id", "intent", "category_code", "record_type")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Incoming rows win; among several for one key the last does."""
    both = base.withColumn("_p", F.lit(1)).unionByName(new.withColumn("_p", F.lit(0)))
    return keep_first(both, key, ["_p", F.desc("row_id")]).drop("_p")


def upsert_keep(base: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """The existing label stays unless it is empty."""
    incoming = keep_first(new, key).select(F.col(key).alias("_k"), F.col(label).alias("_new"))
    joined = base.join(incoming, F.col(key) == F.col("_k"), "full_outer")
    kept = F.when(F.coalesce(F.col(label), F.lit("")) != "", F.col(label))
    return joined.select(F.coalesce(key, "_k").alias(key), F.coalesce(kept, "_new").alias(label))


def union_tagged(frames: dict[str, DataFrame], column: str, columns: Sequence[str]) -> DataFrame:
    """Tables stacked under a constant label each."""
    out = None
    for tag, df in frames.items():
        part = df.select(*columns).withColumn(column, F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def add_increment(base: DataFrame, increment: DataFrame) -> DataFrame:
    return base.unionByName(increment, allowMissingColumns=True)


def route(df: DataFrame, target: DataFrame, action: str = "REPORT_GENERAL") -> DataFrame:
    """Action-like rows become rows of the action table, if their text is new there."""
    _, removed = split_action_like(df)
    fresh = append_new(target, removed)
    return fresh.select("row_id", tx.strip(F.col("text")).alias("text"), F.lit("Action").alias("intent"),
                        F.lit(action).alias("action_type"))


def unique_across(frames: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Case-insensitive unique texts over several tables; the earlier table wins."""
    out = None
    for i, (df, name) in enumerate(zip(frames, names)):
        part = df.select("row_id", "text").withColumn("source", F.lit(name)).withColumn("_p", F.lit(i))
        out = part if out is None else out.unionByName(part)
    key = F.lower(tx.strip(F.col("text")))
    return keep_first(out.filter("text IS NOT NULL"), key, ["_p", "row_id"]).drop("_p")


def label_universe(pairs: DataFrame) -> DataFrame:
    return (pairs.select(F.col("label_true").alias("label")).union(pairs.select("label_pred"))).distinct()


def set_status(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows named in ``changes`` (run_index, status) take the new status."""
    table = changes.select(F.col("run_index").alias("_run"), F.col("status").alias("_status"))
    return (history.join(table, F.col("run_index") == F.col("_run"), "left")
            .withColumn("status", F.coalesce("_status", "status")).drop("_run", "_status"))
