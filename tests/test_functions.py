import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import context, money, payload, timeparse
from tallyspark.functions import text as tx

AMOUNTS = [
    ("45 cành", 45000), ("hai chục", 20000), ("3 loét", 300000), ("củ rưỡi", 1500000), ("hai củ rưỡi", 2500000),
    ("nửa củ", 500000), ("2 lít", 200000), ("15 quả", 15000000), ("một mâm", 1000000), ("năm chục cành", 50000),
    ("mười củ", 10000000), ("25k", 25000),
]
PHRASES = [
    ("Tổng chi tiêu tuần này", "week", "2026-05-25", "2026-05-31"), ("Tháng này tiêu bao nhiêu", "month", "2026-05-01", "2026-05-31"),
    ("Hôm nay chi bao nhiêu", "day", "2026-05-31", "2026-05-31"), ("Hôm qua tiêu gì", "yesterday", "2026-05-30", "2026-05-30"),
    ("Tuần trước sao rồi", "last_week", "2026-05-18", "2026-05-24"), ("Tháng trước tiêu nhiều không", "last_month", "2026-04-01", "2026-04-30"),
    ("Quý này tổng chi", "quarter", "2026-04-01", "2026-05-31"), ("7 ngày qua tiêu bao nhiêu", "rolling_7d", "2026-05-25", "2026-05-31"),
    ("từ 1 đến 10 tháng 2", "custom", "2026-02-01", "2026-02-10"), ("từ ngày 1 đến ngày 31 tháng 2", "month", "2026-05-01", "2026-05-31"),
    ("từ 01/07/2025 đến 10/07/2025", "custom", "2025-07-01", "2025-07-10"), ("thứ năm", "thursday", "2026-05-28", "2026-05-28"),
    ("xóa giao dịch vừa rồi", None, None, None), ("", None, None, None),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    got = many(spark, [t for t, _ in AMOUNTS], money.extract_amounts)
    assert [g[:1] for g in got] == [[a] for _, a in AMOUNTS]


def test_amount_details(spark):
    got = many(spark, ["1tr200", "1tr2", "ăn phở 69.000", "12345k", "không có gì", None], money.extract_amounts)
    assert got[0] == [1200000, 1000000] and got[1][:1] == [1200000] and got[2] == [69000]
    assert got[4] == [] and not got[5]


def test_time_phrases(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i INT, p STRING")
    anchor = F.lit("2026-05-31 15:30:00").cast("timestamp_ntz")
    got = timeparse.with_time_range(rows, F.col("p"), anchor, "r").orderBy("i").collect()
    for row, (_, granularity, start, end) in zip(got, PHRASES):
        if granularity is None:
            assert row["r"] is None
        else:
            assert (row["r"]["granularity"], str(row["r"]["start"]), str(row["r"]["end"])) == (granularity, start, end), row


def test_period_label(spark):
    r = F.struct(F.lit("Tuần này").alias("label"), F.lit(datetime.date(2026, 5, 25)).alias("start"), F.lit(datetime.date(2026, 5, 31)).alias("end"))
    assert one(spark, timeparse.period_label(r)) == "Tuần này (25/05 - 31/05/2026)"


def test_folds(spark):
    assert one(spark, tx.strip_accents(F.lit("Đường phố"))) == "Đuong pho"
    assert one(spark, tx.fold(F.lit(" Đường Phố "))) == "duong pho"


@pytest.mark.parametrize("value, shown", [(1150000, "1.1tr"), (1250000, "1.2tr"), (2000000, "2tr"), (1500, "1.5k"), (50, "0.1k"), (350, "0.3k"), (450, "0.5k")])
def test_compact_money_prints_like_python(spark, value, shown):
    size, unit = (1e6, "tr") if value >= 1e6 else (1e3, "k")
    expected = f"{value / size:.0f}{unit}" if value % size == 0 else f"{value / size:.1f}{unit}"
    assert one(spark, money.compact_money(F.lit(value).cast("bigint"))) == expected
    assert len(shown) == len(expected)


def test_reply_is_cleaned_and_cut(spark):
    text = "vui vui quá 你好 .run(1) {a: 1} " + " ".join(f"từ{i}" for i in range(30)) + " 😀 😀 😀"
    got = one(spark, tx.sanitise_reply(F.lit(text)))
    words = got.split()
    assert got.startswith("vui quá từ0") and "你" not in got and "run" not in got
    assert words[-2:] == ["😀", "😀"] and words[-3].endswith("...") and len(words) == 27


def test_model_json(spark):
    cases = ['{"a": "1"}', '```json\n{"a": "1"}\n```', 'x {"a": "1", "b": {"c": "}"}} y', '{"a": "1", "b": {"c": "d', "no json", None]
    got = many(spark, cases, lambda c: F.get_json_object(payload.parse_model_json(c), "$.a"))
    assert got == ["1", "1", "1", "1", None, None]


def test_receipt_totals(spark):
    rows = spark.createDataFrame([(80000, 80000), (8000, 80000), (None, 80000), (100, 0)], "t BIGINT, s BIGINT")
    got = [tuple(r["x"]) for r in rows.select(money.correct_total(F.col("t"), F.col("s")).alias("x")).collect()]
    assert got == [(80000, None), (80000, "AMOUNT_CORRECTED_SCALE_10X"), (80000, "AMOUNT_SUMMED_FROM_ITEMS"), (100, None)]


def test_pick_total_rules(spark):
    def pick(line):
        return one(spark, money.pick_total(money.amounts_in_line(F.lit(line)), F.lit(line)))

    assert pick("Tong cong 10.000 80.000 80.000") == 80000
    assert pick("Phai thanh toan 100.000 500.000") == 100000
    assert pick("Tien khach tra 90.000 1.000.000") == 90000


def test_triggers_name_the_first_cause(spark):
    cols = [F.lit(v) for v in (500.0, 400.0, 100.0, 1000.0, 9)]
    assert tuple(one(spark, context.trigger(*cols))) == (True, "WARNING_AMOUNT")
    calm = [F.lit(v) for v in (10.0, 400.0, 900.0, 1000.0, 1)]
    assert tuple(one(spark, context.trigger(*calm))) == (False, None)
