"""Readers and writers (S1-S17). Schemas are declared, bad rows are found by value and never dropped by the reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions import text as tx
from tallyspark.operators.dedupe import append_new

#: Quoted line breaks make a file one task; they are read only where the caller asks for them.
CSV = {"quote": '"', "escape": '"', "multiLine": "false"}


def read_labelled(spark: SparkSession, path: str, schema: str, columns: Sequence[str], line_breaks: bool = False) -> DataFrame:
    """Headed CSV (a byte-order mark is skipped by the reader), chosen columns only. ``line_breaks``: fields may hold some."""
    return spark.read.options(**CSV).option("multiLine", line_breaks).option("header", True).schema(schema).csv(path).select(*columns)


def read_headerless(spark: SparkSession, path: str, names: Sequence[str], casts: dict[str, str] | None = None,
                    line_breaks: bool = False) -> DataFrame:
    """CSV without header; rows with too few fields are filtered out, an empty field counts as null.

    The reader marks a row whose number of fields is off; with too few of them the last one is missing.
    """
    text = ", ".join(f"{n} STRING" for n in (*names, "_off"))
    options = CSV | {"multiLine": str(line_breaks).lower(), "columnNameOfCorruptRecord": "_off"}
    rows = spark.read.options(**options).schema(text).csv(path).filter(F.col("_off").isNull() | F.col(names[-1]).isNotNull())
    casts = casts or {}
    return rows.select(*[F.col(n).try_cast(casts[n]).alias(n) if n in casts else F.col(n) for n in names])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each. Such a file cannot be split: many files, not one large one."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_logs_jdbc(spark: SparkSession, url: str, table: str, log_type: str, properties: dict[str, str]) -> DataFrame:
    """Log rows of one type; the filter is pushed to the database. Set partitionColumn, bounds and numPartitions
    in ``properties`` to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **properties).load().filter(F.col("log_type") == log_type)


def logs_of_type(logs: DataFrame, log_type: str) -> DataFrame:
    return logs.filter(F.col("log_type") == log_type)


def open_annotations(raw: DataFrame) -> DataFrame:
    """Packed annotation rows to arrays: polygons (struct), texts, labels, and their number."""
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace("anno_polygons", r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    polygons = F.from_json(literal, schemas.POLYGONS, {"allowSingleQuotes": "true"})
    texts, labels = F.split("anno_texts", r"\|\|\|"), F.split("anno_labels", r"\|\|\|")
    return raw.select("img_id", polygons.alias("polygons"), texts.alias("texts"), labels.alias("labels"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return open_annotations(spark.read.options(**CSV).option("header", True).schema(schemas.ANNOTATIONS).csv(path))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated box transcripts; the sample id is the folder or file that holds them, short rows are left out."""
    rows = spark.read.schema(schemas.TRANSCRIPT).options(sep="\t", quote='"', escape='"').csv(f"{path}/*")
    name = F.col("_metadata.file_path")
    folder = F.regexp_extract(name, r"sample_id=([^/]+)/", 1)
    sample = F.when(folder != "", folder).otherwise(F.regexp_extract(name, r"([^/]+)\.[^./]*$", 1))
    numbers = [F.col(c).try_cast("double").cast("int").alias(c) for c in ("idx", "x0", "y0", "x2", "y2")]
    return rows.filter("label IS NOT NULL").select(sample.alias("sample_id"), *numbers, "text", "label")


def parse_training_log(texts: DataFrame, column: str = "text") -> DataFrame:
    """Points (step, epoch, loss, learning_rate) found in log texts; a point is logged every ten steps."""
    pattern = r"\{'loss':\s*([0-9.]+),\s*'grad_norm':\s*[0-9.]+,\s*'learning_rate':\s*([0-9.]+),\s*'epoch':\s*([0-9.]+)\}"
    found = [F.regexp_extract_all(column, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    points = F.arrays_zip(*[c.alias(n) for c, n in zip(found, ("loss", "learning_rate", "epoch"))])
    keys = [c for c in texts.columns if c != column]
    rows = texts.select(*keys, F.posexplode(points).alias("i", "p"))
    return rows.select(*keys, ((F.col("i") + 1) * 10).alias("step"), *[
        F.col(f"p.{n}").try_cast("double").alias(n) for n in ("epoch", "loss", "learning_rate")])


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").options(**CSV).option("header", header).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def transcript_rows(boxes: DataFrame) -> DataFrame:
    """Verified boxes as transcript rows: clockwise corners, blanks for tabs and newlines, O as OTHER.

    ``boxes`` has sample_id, box_no, x1..y2, text, admin_label and auto_label; the admin label goes first.
    """
    label = F.upper(F.trim(F.coalesce("admin_label", "auto_label", F.lit("OTHER"))))
    text = F.translate(tx.strip(F.col("text")), "\t\n", "  ")
    return boxes.select(
        "sample_id", F.col("box_no").alias("idx"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"),
        F.col("y1").alias("y1"), "x2", "y2", F.col("x1").alias("x3"), F.col("y2").alias("y3"), text.alias("text"),
        F.when(label == "O", "OTHER").otherwise(label).alias("label"))


def write_transcripts(rows: DataFrame, path: str) -> None:
    """One folder of tab-separated files per sample."""
    rows.repartition("sample_id").write.mode("overwrite").partitionBy("sample_id").options(sep="\t", quote='"', escape='"').csv(path)


def quad_lines(boxes: DataFrame) -> DataFrame:
    """``x1,y1,...,text,ENTITY`` lines of boxes with flat coordinate arrays, padded to eight numbers."""
    coords = F.slice(F.concat("coords", F.array_repeat(F.lit(0), 8)), 1, 8)
    line = F.concat_ws(",", F.array_join(F.transform(coords, lambda c: c.cast("int").cast("string")), ","), tx.strip(F.col("text")),
                       F.upper(F.coalesce("entity", F.lit("OTHER"))))
    return boxes.filter(F.size("coords") > 0).select("image", "box_no", line.alias("line"))


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics by task; only the tasks present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """The path is there; any other fault of the store is raised."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    if not exists(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]


def append_fresh(spark: SparkSession, path: str, batch: DataFrame, schema: str) -> None:
    """Append the rows whose text the sink does not hold yet."""
    sink = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    append_new(sink, batch).write.mode("append").parquet(path)


def manifest(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Training manifest of the samples whose image exists."""
    have = files.select(F.col("image").alias("_img")).distinct()
    rows = samples.join(have, F.col("image") == F.col("_img"), "left_semi")
    return rows.select(F.concat(F.lit("images/"), "image").alias("image"), "sample_id", F.lit("train").alias("split"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the image files below a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("image"))


def tag_lines(tokens: DataFrame, doc: str = "receipt_id") -> DataFrame:
    """Predicted tags of a document joined by blanks, in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "tag")))
    return tokens.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["tag"]), " ").alias("tags"))
