"""From raw documents to packed sequences: quality, repeated lines, near copies, mixture, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import lines, mixing, packing, partenum, quality
from tallyspark.llm.common import bounded_broadcast, documents, written
from tallyspark.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of rows to leave out that may be broadcast; more are joined by a shuffle.
MAX_KEYS = 1_000_000


def _key() -> Column:
    """Id and content of a row; rows that agree in both are judged alike."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the robust estimates reject go.

    Null and empty texts have too few words and go. Null languages and sources are strata of their own, null ids are
    allowed, and rows that agree in id and text share one verdict. An empty table stays empty.
    """
    keyed = docs.select(_key().alias("doc_id"), "text", "lang", "source")
    rejected = quality.judged(keyed).filter("not kept").select(F.col("doc_id").alias("_key")).distinct()
    out = written(rejected, "rejected")
    return docs.select(*COLUMNS, _key().alias("_key")).join(bounded_broadcast(out, MAX_KEYS), "_key", "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of the corpus equals or nearly equals go, and rows of which nothing but white space is left.

    A null text stays null; a row that was blank before stays. Null ids come last; of repeated rows the first keeps its
    lines. Lines of any length are compared whole. An empty table stays empty.
    """
    out = lines.dedup_lines(docs, carry=("lang", "source"))
    gone = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(F.col("text").isNull() | ~gone).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by near-equal shingle sets the one of smallest id stays; null ids stay.

    Null and blank texts have no set and stay. Rows that repeat the id that stays, stay with it. Texts of any length are
    compared whole. An empty table stays empty.
    """
    dropped = partenum.jaccard_join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(bounded_broadcast(written(dropped, "near-copies"), MAX_KEYS), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target asks for; a part of a row is its first words.

    Rows without words are taken by no source and go. A null source is a source of its own; null ids are drawn as one id,
    repeated rows one after the other. An empty table stays empty.
    """
    mixed = mixing.repeated(mixing.mix(docs, carry=("text", "lang", "source")))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed windows; a row of null or empty text is its end id alone. An empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: No SQL for robust estimates and tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
