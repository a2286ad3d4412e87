"""Declared schemas of the tables that are read from files."""

RECORDS = "text STRING, label STRING, type STRING, is_money INT"
CHITCHAT = "text STRING, intent STRING, sentiment STRING"
SPANS = "text STRING, label ARRAY<STRUCT<start: INT, end: INT, tag: STRING>>"
INTERACTIONS = "text_input STRING, intent STRING, category STRING, payload STRING, log_type STRING"
ANNOTATIONS = "img_id STRING, anno_polygons STRING, anno_texts STRING, anno_labels STRING"
POLYGONS = "ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, width: DOUBLE, height: DOUBLE>>"
TRANSCRIPT = ("idx STRING, x0 STRING, y0 STRING, x1 STRING, y1 STRING, x2 STRING, y2 STRING, x3 STRING, y3 STRING, "
              "text STRING, label STRING")
BENCHMARK_FLAT = ("text STRING, expected_intent STRING, expected_category STRING, expected_record_type STRING, "
                  "expected_action_type STRING")
