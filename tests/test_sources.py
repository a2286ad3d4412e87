import json

import pytest

from tallyspark import schemas
from tallyspark.sources import io


def test_labelled_csv_with_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿text,label,type,is_money\n"mua ""x"", 20k",Food,expense,1\n', encoding="utf-8")
    got = io.read_labelled(spark, str(tmp_path), schemas.RECORDS, ["text", "label"]).collect()
    assert [tuple(r) for r in got] == [('mua "x", 20k', "Food")]


def test_headerless_drops_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mua gạo,Food,expense,1\nthiếu,Food\nxăng,Transport,expense,x\n", encoding="utf-8")
    got = io.read_headerless(spark, str(tmp_path), ["text", "label", "type", "is_money"], {"is_money": "int"}).orderBy("text").collect()
    assert [tuple(r) for r in got] == [("mua gạo", "Food", "expense", 1), ("xăng", "Transport", "expense", None)]


def test_headerless_tells_empty_from_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mua gạo,Food,expense,\nthiếu,Food,expense\n", encoding="utf-8")
    got = io.read_headerless(spark, str(tmp_path), ["text", "label", "type", "is_money"]).collect()
    assert [tuple(r) for r in got] == [("mua gạo", "Food", "expense", None)]


def test_line_breaks_in_fields(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb", "Food"), ('say "x",\ny', "Other")], "text STRING, label STRING")
    io.write_csv(rows, str(tmp_path / "t"))
    got = io.read_labelled(spark, str(tmp_path / "t"), "text STRING, label STRING", ["text", "label"], line_breaks=True)
    assert sorted(map(tuple, got.collect())) == [("a\nb", "Food"), ('say "x",\ny', "Other")]
    io.write_csv(rows, str(tmp_path / "h"), header=False)
    assert io.read_headerless(spark, str(tmp_path / "h"), ["text", "label"], line_breaks=True).count() == 2


def test_append_fresh(spark, tmp_path):
    schema, path = "row_id LONG, text STRING", str(tmp_path / "sink")
    for batch in ([(1, "a"), (2, "b")], [(3, " b "), (4, "c")]):
        io.append_fresh(spark, path, spark.createDataFrame(batch, schema), schema)
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="."):
        io.append_fresh(spark, str(tmp_path / "bad"), spark.createDataFrame([(1, "a")], schema), schema)


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "a", "intent": "x"}, {"text": "b"}]), encoding="utf-8")
    assert io.read_json_array(spark, str(tmp_path), schemas.CHITCHAT).count() == 2


def test_transcript_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([("s1", 0, 1, 2, 3, 4, " tab\there ", "o", None), ("s2", 0, 5, 6, 7, 8, "x", None, "total_cost")],
                                  "sample_id STRING, box_no INT, x1 INT, y1 INT, x2 INT, y2 INT, text STRING, admin_label STRING, auto_label STRING")
    io.write_transcripts(io.transcript_rows(boxes), str(tmp_path / "t"))
    got = io.read_transcripts(spark, str(tmp_path / "t")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.x0, r.y2, r.text, r.label) for r in got] == [("s1", 1, 4, "tab here", "OTHER"), ("s2", 5, 8, "x", "TOTAL_COST")]


def test_transcript_sample_from_file_name(spark, tmp_path):
    (tmp_path / "bill7.tsv").write_text("0\t1\t2\t3\t2\t3\t4\t1\t4\tshop\tSELLER\nshort\trow\n", encoding="utf-8")
    got = io.read_transcripts(spark, str(tmp_path)).collect()
    assert [(r.sample_id, r.text, r.label) for r in got] == [("bill7", "shop", "SELLER")]


def test_annotations_with_none(spark):
    raw = spark.createDataFrame([("a.jpg", "[{'bbox': [1, 2, 3, 4], 'width': 10, 'height': 20, 'area': None, 'crowd': False}]", "x|||y", "SELLER|||O")], schemas.ANNOTATIONS)
    row = io.open_annotations(raw).first()
    assert row.polygons[0]["bbox"] == [1.0, 2.0, 3.0, 4.0] and row.texts == ["x", "y"] and row.labels == ["SELLER", "O"]


def test_manifest_and_image_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    samples = spark.createDataFrame([("s1", "a.jpg"), ("s2", "b.jpg")], "sample_id STRING, image STRING")
    got = io.manifest(samples, io.image_files(spark, str(tmp_path))).collect()
    assert [(r.image, r.sample_id) for r in got] == [("images/a.jpg", "s1")]


def test_training_log(spark):
    log = "{'loss': 2.1, 'grad_norm': 0.5, 'learning_rate': 0.0002, 'epoch': 0.03} noise {'loss': 1.9, 'grad_norm': 0.5, 'learning_rate': 0.0001, 'epoch': 0.06}"
    got = io.parse_training_log(spark.createDataFrame([(1, log)], "id INT, text STRING")).orderBy("step").collect()
    assert [(r.step, r.loss, r.epoch) for r in got] == [(10, 2.1, 0.03), (20, 1.9, 0.06)]
    assert io.quad_lines(spark.createDataFrame([("i", 0, [1, 2, 3], " a ", None)], "image STRING, box_no INT, coords ARRAY<INT>, text STRING, entity STRING")).first().line == "1,2,3,0,0,0,0,0,a,OTHER"
