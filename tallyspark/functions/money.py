"""Money in text: slang, amounts, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions.text import FLAGS, collapse_ws, bind, first_match, fold_marks, matches, strip, strip_accents


def preprocess_slang(col: Column) -> Column:
    """Number words before a unit, "half", and "and a half" become digits."""
    slang = "|".join([*rules.NUMBER_WORDS.values(), "nửa|nua|rưỡi|ruoi"])

    def rewrite(text: Column) -> Column:
        out = text
        for digit, words in rules.NUMBER_WORDS.items():
            out = F.regexp_replace(out, rf"(?U)\b(?:{words})\b(?=\s*(?:{rules.NUMBER_WORD_UNITS})\b)", digit)
        out = F.regexp_replace(out, r"(?U)\b(?:nửa|nua)\s+(?:triệu|trieu|củ|cu)\b", "500k")
        out = F.regexp_replace(out, r"(?U)(?<![0-9.,])([0-9]+)\s*(?:triệu|trieu|củ|cu)\s*(?:rưỡi|ruoi)\b", "$1.5 triệu")
        out = F.regexp_replace(out, r"(?U)\b(?:triệu|trieu|củ|cu)\s*(?:rưỡi|ruoi)\b", "1.5 triệu")
        return F.when(text.rlike(rf"(?U)\b(?:{slang})\b"), out).otherwise(text)

    return bind(F.lower(strip(col)), rewrite)


def _whole(col: Column) -> Column:
    """Half-even rounding to a whole amount."""
    return F.bround(col, 0).cast("bigint")


def parse_plain_amount(token: Column) -> Column:
    """Digits with dot or comma grouping; NULL unless positive, and if a dot follows the last of the commas."""
    mixed = token.contains(",") & F.substring_index(token, ",", -1).contains(".")
    digits = F.when(~mixed, F.regexp_replace(strip(token), "[.,]", "").try_cast("bigint"))
    return F.when(digits > 0, digits)


def extract_amounts(col: Column) -> Column:
    """All amounts: million composites, then amounts with a unit, then plain numbers."""
    return bind(preprocess_slang(col), lambda text: F.when(text.rlike("[0-9]"), _amounts(text)).otherwise(
        F.array().cast("array<bigint>")))


def _amounts(text: Column) -> Column:
    """Amounts of lower-case text whose slang is already digits."""
    composite = r"([0-9]+)\s*(?:tr|trieu|triệu)\s*([0-9]{1,3})(?![0-9])"
    millions = F.regexp_extract_all(text, F.lit("(?U)" + composite), F.lit(1))
    rests = F.regexp_extract_all(text, F.lit("(?U)" + composite), F.lit(2))
    composites = F.zip_with(millions, rests, lambda m, r: m.try_cast("bigint") * 1_000_000 + F.when(
        F.length(r) == 1, r.try_cast("bigint") * 100_000).otherwise(r.try_cast("bigint") * 1_000))

    amount = rf"([0-9]+(?:[.,][0-9]+)?)\s*({rules.AMOUNT_UNITS})"
    numbers = F.regexp_extract_all(text, F.lit("(?U)" + amount), F.lit(1))
    units = F.regexp_extract_all(text, F.lit("(?U)" + amount), F.lit(2))

    def value(number: Column, unit: Column) -> Column:
        factor = first_match([(unit.isin(names), float(mult)) for mult, names in rules.UNIT_VALUES.items()], 1.0)
        return _whole(F.translate(number, ",", ".").try_cast("double") * factor)

    with_units = F.zip_with(numbers, units, value)
    plain = (r"(?<![0-9.])([0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{4,})"
             rf"(?!\s*(?:{rules.PLAIN_STOP_UNITS})\b)")
    plains = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit("(?U)" + plain), F.lit(1)), parse_plain_amount),
        lambda v: v.isNotNull())
    return F.concat(composites, with_units, plains)


def clean_content(col: Column) -> Column:
    """The utterance without its amounts, common typos repaired."""
    amount = rf"{FLAGS}[0-9]+(?:[.,][0-9]+)?\s*(?:{rules.AMOUNT_UNITS})"
    text = collapse_ws(F.lower(F.regexp_replace(preprocess_slang(col), amount, " ")))
    for wrong, right in rules.TYPOS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return collapse_ws(text)


def parse_receipt_amount(token: Column) -> Column:
    """Receipt flavour: a group of three after the last separator is thousands, else the comma is decimal."""
    t = strip(token)
    comma, dot = t.contains(","), t.contains(".")
    last_comma = F.length(t) - F.instr(F.reverse(t), ",")
    last_dot = F.length(t) - F.instr(F.reverse(t), ".")
    no_comma = F.replace(t, F.lit(","), F.lit(""))
    both = F.when(last_comma > last_dot, F.translate(t, ",.", ".")).otherwise(no_comma)
    dots = F.when(t.rlike(r"^[^.]*(?:\.[^.]{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    plain = F.when(comma & dot, both).when(dot, dots).otherwise(no_comma)
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("bigint"))


def is_noise_amount(value: Column, line: Column, token: Column) -> Column:
    """Too small, too large, undelimited long numbers and document numbers."""
    digits = F.length(value.cast("string"))
    document = (digits >= 10) & matches(line, rules.DOCUMENT_NUMBER)
    return (value < 1000) | (value > 50_000_000) | ((digits >= 8) & ~token.rlike("[.,]")) | document


def repair_ocr_amount(line: Column) -> Column:
    """``12,(50`` is a misread ``12,500``."""
    return F.regexp_replace(line, r"([0-9]{1,7}),\(([0-9]{2})(?![0-9])", "$1,$20")


def amounts_in_line(line: Column) -> Column:
    def read(fixed: Column) -> Column:
        tokens = F.regexp_extract_all(fixed, F.lit(rules.AMOUNT_TOKEN), F.lit(1))
        pairs = F.transform(tokens, lambda t: F.struct(t.alias("t"), parse_receipt_amount(t).alias("v")))
        kept = F.filter(pairs, lambda p: p["v"].isNotNull() & ~is_noise_amount(p["v"], fixed, p["t"]))
        return F.transform(kept, lambda p: p["v"])

    # Lines without four digits or a grouped number cannot hold an amount.
    return F.when(line.rlike(r"[0-9]{4}|[0-9][.,][0-9(]"), bind(repair_ocr_amount(line), read)).otherwise(
        F.array().cast("array<bigint>"))


def item_line_amount(line: Column) -> Column:
    """Two equal amounts at the end of the line."""
    pattern = r"([0-9.,]+)\s+([0-9.,]+)\s*$"
    a = parse_receipt_amount(F.regexp_extract(strip(line), pattern, 1))
    b = parse_receipt_amount(F.regexp_extract(strip(line), pattern, 2))
    return F.when((a == b) & (a >= 1000), a)


def line_total_score(line: Column) -> Column:
    """How much a line looks like the total line; 0 for lines that never are."""
    ordered = sorted(rules.TOTAL_LINE_SCORES, reverse=True)  # the highest score is the first that matches
    any_rule = "|".join(pattern for _, pattern in rules.TOTAL_LINE_SCORES)

    def score(low: Column) -> Column:
        best = first_match([(matches(low, pattern), value) for value, pattern in ordered], 0)
        return F.when(matches(low, rules.SKIP_LINE), 0).when(
            strip_accents(low).contains(rules.CHANGE_LINE), 30).otherwise(F.when(matches(low, any_rule), best).otherwise(0))

    return bind(F.lower(line), score)


def pick_total(amounts: Column, line: Column) -> Column:
    """Largest repeated amount, else the rule for pay lines, else the largest."""
    low = fold_marks(line)
    repeated = F.array_max(F.filter(amounts, lambda a: F.size(F.filter(amounts, lambda b: a == b)) >= 2))
    ordered = F.sort_array(amounts, asc=False)
    top, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    pay = F.when(low.contains("phai") & low.contains("toan") & (top >= second * 1.4), second)
    guest = F.when(low.contains("tien khach tra"), F.array_max(F.filter(amounts, lambda a: a <= 500_000)))
    return F.coalesce(repeated, pay, guest, F.array_max(amounts))


def correct_total(total: Column, items_sum: Column) -> Column:
    """Total checked against the item sum: struct(amount, warning)."""
    def near(factor: int) -> Column:
        return F.abs(items_sum - total * factor) <= items_sum * 0.05

    amount = first_match([
        (items_sum.isNull() | (items_sum == 0), total),
        (total.isNull() | near(10) | near(100) | near(1) | near(1000), items_sum),
    ], total)
    warning = first_match([
        (items_sum.isNull() | (items_sum == 0), None),
        (total.isNull(), "AMOUNT_SUMMED_FROM_ITEMS"),
        (near(10), "AMOUNT_CORRECTED_SCALE_10X"),
        (near(100), "AMOUNT_CORRECTED_SCALE_100X"),
        (near(1), None),
        (near(1000), "AMOUNT_CORRECTED_SCALE_1000X"),
    ])
    return F.struct(amount.cast("bigint").alias("amount"), warning.cast("string").alias("warning"))


def is_amount_token(col: Column) -> Column:
    return F.translate(F.lower(col), "., đd", "").rlike("^[0-9]+$")


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "").try_cast("bigint")


def _decimal_text(value: Column, digits: int) -> Column:
    """Fixed decimals without trailing zeros or point."""
    text = F.format_string(f"%.{digits}f", value)
    return F.regexp_replace(text, r"\.?0+$", "")


def _one_decimal(value: Column, unit: int) -> Column:
    """value / unit with one decimal, rounded by the exact binary quotient as C and Python print it."""
    quotient = value.cast("double") / float(unit)
    tenth = F.floor(F.pmod(value, F.lit(unit)) * 10 / unit).cast("bigint")
    exact = ((quotient - F.floor(quotient)) * float(2**57)).cast("bigint") * 20  # the fraction has at most 57 bits
    half = (2 * tenth + 1) * F.lit(2**57)
    up = (exact > half) | ((exact == half) & (tenth % 2 == 1))
    tenths = F.floor(value / unit).cast("bigint") * 10 + tenth + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def compact_money(value: Column) -> Column:
    """``1.5tr`` from a million on, else ``12.5k``."""
    def unit(size: int, name: str) -> Column:
        whole = F.pmod(value, F.lit(size)) == 0
        return F.concat(F.when(whole, F.floor(value / size).cast("string")).otherwise(_one_decimal(value, size)), F.lit(name))

    return F.when(value >= 1_000_000, unit(1_000_000, "tr")).otherwise(unit(1_000, "k"))


def dotted_thousands(value: Column) -> Column:
    return F.translate(F.format_number(value, 0), ",", ".")


def money_text(i: Column) -> Column:
    """Twelve spellings of an amount derived from an integer."""
    base = F.lit(6_000) + F.pmod(i * 8353, F.lit(2_500_000))
    k = F.floor(base / 1000)
    tenth = F.floor(F.pmod(base, F.lit(1000)) / 100)
    kind = F.pmod(i * 29, F.lit(12))
    ks = k.cast("string")
    rest = F.when(F.pmod(base, F.lit(1000)) > 0, F.concat(ks, F.lit("."), tenth.cast("string"), F.lit("k"))).otherwise(
        F.concat(ks, F.lit("k")))
    tail = {0: "k", 1: "K", 2: " xị", 3: " nghìn", 4: " ngàn", 5: " ngan", 6: " nghin", 9: "k VND"}
    cases = [(kind == n, F.concat(ks, F.lit(t))) for n, t in tail.items()]
    cases += [
        (kind == 7, F.concat(dotted_thousands(base), F.lit("đ"))),
        (kind == 8, F.concat(dotted_thousands(base), F.lit(" vnd"))),
        ((kind == 10) & (k >= 80), F.concat(_decimal_text(base / 1_000_000, 2), F.lit(" tr"))),
        ((kind == 11) & (k >= 500), F.concat(F.floor(k / 100).cast("string"), F.lit(" củ"))),
    ]
    return first_match(cases, rest)


def money_text_short(i: Column) -> Column:
    """Eight spellings of an amount derived from an integer."""
    base = F.lit(12_000) + F.pmod(i * 9973, F.lit(9_500_000))
    k = F.floor(base / 1000)
    tenth = F.floor(F.pmod(base, F.lit(1000)) / 100)
    roll = F.pmod(i * 17, F.lit(8))
    ks, hundreds = k.cast("string"), F.floor(k / 100).cast("string")
    left = F.pmod(k, F.lit(100))
    return first_match([
        ((roll == 0) & (base >= 1_000_000), F.concat(_decimal_text(base / 1_000_000, 1), F.lit("tr"))),
        ((roll == 1) & (k >= 100) & (left > 0),
         F.concat(hundreds, F.lit("tr"), F.lpad(left.cast("string"), 2, "0"), F.lit("k"))),
        ((roll == 1) & (k >= 100), F.concat(hundreds, F.lit("tr"))),
        (roll == 2, F.concat(ks, F.lit(" ngan"))),
        ((roll == 3) & (k >= 200), F.concat(hundreds, F.lit(" củ"))),
        ((roll == 4) & (tenth > 0), F.concat(ks, F.lit("."), tenth.cast("string"), F.lit("k"))),
    ], F.concat(ks, F.lit("k")))
