"""SQL snippets for the DuckDB twins (RE2 patterns: no look-around, ASCII word boundaries)."""

from __future__ import annotations

from tallyspark import rules

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def fold_marks(x: str) -> str:
    return f"lower(strip_accents({x}))"


def fold(x: str) -> str:
    return f"trim(replace({fold_marks(x)}, 'đ', 'd'))"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + pattern)})"


def rsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit('(?i)' + pattern)}, {lit(to)}, 'g')"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def mask(x: str) -> str:
    return ws(rsub(f"lower(trim({x}))", rules.MONEY, " <AMOUNT> "))


def has_money(x: str) -> str:
    return rx(x, rules.MONEY + r"(?:[^\pL\pN_]|$)")


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def case_map(x: str, table: dict, default: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def strip_hash(x: str) -> str:
    """Runs of `` #1`` noise; the view has at most one per text."""
    return ws(rsub(x, r"\s#[0-9]+(\s|$)", r"\1"))


def keep_first(rel: str, key: str, order: str = "row_id", cols: str = "*") -> str:
    return f"SELECT {cols} FROM {rel} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


ACTION_LIKE = f"(NOT {has_money(fold_marks('text'))} AND {rx(fold_marks('text'), rules.ACTION_LIKE)})"


def family_gift(x: str) -> str:
    return f"({rx(fold_marks(x), rules.FAMILY_GIFT)} AND NOT {rx(fold_marks(x), rules.FAMILY_VETO)})"


def hint(x: str) -> str:
    t = fold(x)
    return (
        f"CASE WHEN {rx(t, rules.GIFT_BUY)} THEN 'Essentials' WHEN {rx(t, rules.GADGET)} THEN 'Shopping' "
        f"WHEN {rx(t, rules.GROCERY)} THEN 'Essentials' "
        f"WHEN {rx(t, rules.OUTING_CAFE)} OR {rx(t, rules.OUTING_OTHER)} THEN 'Entertainment' "
        f"WHEN {rx(t, rules.COFFEE)} THEN 'Food' "
        f"WHEN {rx(t, rules.MEAT)} AND NOT {rx(t, rules.SELL)} THEN 'Food' END")


def sell(x: str) -> str:
    return rx(fold(x), rules.SELL)


def buy(x: str) -> str:
    return f"({rx(fold(x), rules.BUY)} AND lower(type) = 'income' AND NOT {rx(fold(x), rules.REFUND)})"


TYPE_FIXED = f"CASE WHEN {sell('text')} THEN 'income' WHEN {buy('text')} THEN 'expense' ELSE type END"
LABEL_FIXED = (
    f"CASE WHEN {sell('text')} AND coalesce(label NOT IN ('Business','Salary','Bonus','Investment'), true) "
    "THEN 'Business' ELSE label END")


def drop_words(x: str, words: str) -> str:
    """Whole words gone; run twice because neighbours share the character between them."""
    pattern = r"(^|[^\pL\pN_])(?:" + words + r")([^\pL\pN_]|$)"
    return rsub(rsub(x, pattern, r"\1 \2"), pattern, r"\1 \2")


def clean_category(x: str) -> str:
    money = rsub(f"lower(trim({x}))", rules.CATEGORY_MONEY, " ")
    return ws(drop_words(drop_words(money, rules.PAYMENT_WORDS), rules.RECEIPT_WORDS))


def blank(x: str) -> str:
    return f"CASE WHEN lower(trim(CAST({x} AS VARCHAR))) NOT IN ('', 'nan', 'none') THEN trim(CAST({x} AS VARCHAR)) END"


def draw(key: str, seed: int = 42) -> str:
    return f"md5(concat('{seed}:', {key}))"


def canon_intent(x: str, unknown: str = "Unknown") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {case_map(f'lower(trim({x}))', rules.INTENT_ALIASES, lit(unknown))} END"
