"""Token files: flat unsigned 16- or 32-bit ids with 64-bit document offsets, written in parts and memory-mapped."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import tokens
from tallyspark.session import scratch

MANIFEST = "manifest.json"
_SUMMARY = "part long, name string, docs long, nulls long, tokens long, size long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(uri: str):
    """A file system and path of a folder that all executors reach (file:, hdfs:, s3:, gs: or a plain path)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _buffer(store, path: str):
    """The file's bytes: mapped where the folder is mounted, else read."""
    import pyarrow as pa
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as file:
        return file.read_buffer()


def write_token_file(docs: DataFrame, folder: str, path: str, partitions: int | None = None) -> list[dict]:
    """Writes ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order below ``folder`` and returns the manifest.

    A range partition of the ids is one part: ``NAME.bin`` (ids of its documents, each with the end id, unsigned
    little-endian, 2 bytes wide where the vocabulary fits, else 4; the manifest has the ``size``), ``NAME.doc``
    (64-bit document ids) and ``NAME.idx`` (64-bit offsets into all ids of the file set, one more than documents). A
    part's base is the sum of the ids in the parts before it; there is one manifest row per partition, so the prefix
    sum is small at any size. Names carry the task attempt: a repeated or speculative task writes files of its own and
    the manifest lists those of the attempt that counted.

    Null text: empty, the end id alone. Null ids come last, in one run. Rows of one id are ordered by text. Other
    columns are ignored. All rows of one id, and all null ids, lie in one part. A text of any length is one run of ids in
    its part. An empty table gives parts without documents.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, root = _store(folder)
        ids, counts, nulls, size = array("q"), array("Q"), 0, tokens.Encoder.of(path).size
        with store.open_output_stream(f"{root}/{name}.bin") as out:
            for doc_ids, encoded, _ in tokens.encoded(batches, path):
                out.write(b"".join(encoded))
                nulls += doc_ids.count(None)
                ids.extend(0 if i is None else i for i in doc_ids)
                counts.extend(len(e) // size for e in encoded)
        for kind, data in (("doc", ids), ("len", counts)):
            with store.open_output_stream(f"{root}/{name}.{kind}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pylist([{
            "part": task.partitionId(), "name": name, "docs": len(ids), "nulls": nulls,
            "tokens": sum(counts), "size": size}])

    manifest, base = [], 0
    for row in sorted(dealt.mapInArrow(write, _SUMMARY).collect(), key=lambda r: r.part):
        manifest.append(row.asDict() | {"base": base})
        base += row.tokens

    def place(batches: Iterator) -> Iterator:
        for batch in batches:
            store, root = _store(folder)
            for part in batch.column(0).to_pylist():
                entry = manifest[part]
                counts = np.frombuffer(_buffer(store, f"{root}/{entry['name']}.len"), dtype="<u8")
                offsets = np.zeros(len(counts) + 1, dtype="<u8")
                offsets[1:] = np.cumsum(counts)
                with store.open_output_stream(f"{root}/{entry['name']}.idx") as out:
                    out.write((offsets + np.uint64(entry["base"])).tobytes())
            yield batch

    numbered = spark.range(0, len(manifest), 1, max(1, len(manifest)))
    numbered.mapInArrow(place, "id long").count()
    store, root = _store(folder)
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_token_file(spark: SparkSession, folder: str, rows: int = 4096) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the mapped files; a task per part."""
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{MANIFEST}") as file:
        manifest = json.loads(file.read())

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            store, root = _store(folder)
            for part in batch.column(0).to_pylist():
                entry = manifest[part]
                if not entry["docs"]:
                    continue
                path = f"{root}/{entry['name']}"
                ids = np.frombuffer(_buffer(store, f"{path}.doc"), dtype="<i8")
                offsets = np.frombuffer(_buffer(store, f"{path}.idx"), dtype="<u8").astype("int64")
                data = memoryview(_buffer(store, f"{path}.bin")) if entry["tokens"] else memoryview(b"")
                local = (offsets - entry["base"]) * entry["size"]
                for at in range(0, entry["docs"], rows):
                    to = min(at + rows, entry["docs"])
                    crc = [zlib.crc32(tokens.wide(data[local[i]:local[i + 1]], entry["size"])) for i in range(at, to)]
                    doc = pa.array(ids[at:to], mask=np.arange(at, to) >= entry["docs"] - entry["nulls"])
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array(offsets[at:to]), pa.array(np.diff(offsets[at:to + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(read, _ROWS)


def token_file_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes the token file of ``docs`` below the shared folder and returns what its files say of each document."""
    folder = scratch(docs.sparkSession, "tokens")
    write_token_file(docs, folder, path)
    return read_token_file(docs.sparkSession, folder)
