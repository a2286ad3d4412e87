"""Text columns: folding, masking, cleaning, splitting, tagging."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import rules

# Java patterns are ASCII-only for \b, \w and \s unless these flags are on.
FLAGS = "(?iU)"


@lru_cache(maxsize=1)
def _accent_pairs() -> tuple[str, str]:
    """Precomposed letters and their base letters, derived from the Unicode tables."""
    letters, bases = [], []
    for code in range(0xC0, 0x3100):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            letters.append(chr(code))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)


@lru_cache(maxsize=1)
def _white_space() -> str:
    return "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(col: Column) -> Column:
    """Trim every kind of white space (the built-in default trims blanks only)."""
    return F.trim(col, F.lit(_white_space()))


def _is_ascii(col: Column) -> Column:
    """True if every character takes one byte; such text has no accents and needs no Unicode classes."""
    return F.octet_length(col) == F.char_length(col)


def strip_accents(col: Column) -> Column:
    """Drop combining marks; the letter d-bar has none and stays."""
    letters, bases = _accent_pairs()
    return F.when(_is_ascii(col), col).otherwise(F.regexp_replace(F.translate(col, letters, bases), r"\p{Mn}+", ""))


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once.

    Later filters on a plain computed column are pushed below it by copying its expression; a generated column
    stays where it is. Meant for long rule chains.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fold_marks(col: Column) -> Column:
    """Lower case without accents; d-bar is kept."""
    return F.lower(strip_accents(col))


def fold(col: Column) -> Column:
    """Lower case, no accents, d-bar as d, trimmed: the key for rules written without accents."""
    return strip(F.translate(F.lower(strip_accents(col)), "đ", "d"))


def collapse_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive search. Patterns are lower case, so lowering the text saves the slow Unicode case folding."""
    return F.when(_is_ascii(col), F.lower(col).rlike(pattern)).otherwise(F.lower(col).rlike("(?U)" + pattern))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """Ordered rules, first true one wins."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(col: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value from a small constant table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), col)
    return hit if default is None else F.coalesce(hit, default)


def blank_to_null(col: Column) -> Column:
    """Every spelling of "no label" becomes NULL."""
    text = strip(col.cast("string"))
    return F.when(~F.lower(text).isin(rules.EMPTY_WORDS), text)


def mask_amounts(col: Column) -> Column:
    masked = F.regexp_replace(F.lower(strip(col)), FLAGS + rules.MONEY, " <AMOUNT> ")
    return collapse_ws(masked)


def clean_category_text(col: Column) -> Column:
    """Drop money, payment words and receipt boilerplate."""
    text = F.regexp_replace(F.lower(strip(col)), FLAGS + rules.CATEGORY_MONEY, " ")
    text = F.regexp_replace(text, rf"{FLAGS}\b(?:{rules.PAYMENT_WORDS})\b", " ")
    text = F.regexp_replace(text, rf"{FLAGS}\b(?:{rules.RECEIPT_WORDS})\b", " ")
    return collapse_ws(text)


def ascii_tokens(col: Column) -> Column:
    """Lower-case ASCII words; accented letters split words (parity mode)."""
    kept = collapse_ws(F.regexp_replace(F.lower(col), r"[^0-9a-zA-Z_\s]", " "))
    return F.filter(F.split(kept, " "), lambda w: w != "")


def letter_tokens(col: Column) -> Column:
    """Lower-case words of letters, digits and underscore in any script."""
    kept = collapse_ws(F.regexp_replace(F.lower(col), r"[^\p{L}\p{M}\p{N}_\s]", " "))
    return F.filter(F.split(kept, " "), lambda w: w != "")


def strip_hash_id(col: Column) -> Column:
    """Drop `` #123`` noise that stands before white space or the end."""
    return collapse_ws(F.regexp_replace(col, r"(?U)\s#[0-9]+(?=\s|$)", ""))


def split_segments(col: Column) -> Column:
    """Comma, semicolon, bar, newline, plus and the word for "and" separate segments."""
    text = strip(F.coalesce(col, F.lit("")))
    parts = F.split(text, FLAGS + r"\s*[,;|]\s*|\n\s*|\s+và\s+|\s+\+\s+")
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def log_lines(col: Column) -> Column:
    """Lines without list numbers or bullets that are long enough and hold a digit."""
    lines = F.transform(F.split(col, r"\r\n|\n|\r"), lambda x: F.regexp_replace(strip(x), r"^[0-9]+[.)]\s*", ""))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^[-•* ]+|[-•* ]+$", ""))
    return F.filter(lines, lambda x: (F.length(x) >= 4) & x.rlike("[0-9]"))


def sanitise_reply(col: Column, max_words: int = 25) -> Column:
    """Drop CJK, code and comments, merge doubled words, cap the words and keep two emoji."""
    text = F.regexp_replace(col, "[　-〿぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯]+", "")
    text = F.regexp_replace(text, r"(?U)\.\w+\([^)]*\)", "")
    text = F.regexp_replace(text, r"\{[^}]{0,200}\}", "")
    text = F.regexp_replace(text, r"//[^\n]*", "")
    text = F.regexp_replace(text, r"(?U)\b(\w{3,})\s+\1\b", "$1")
    text = strip(F.regexp_replace(text, r"(?U)\s{2,}", " "))
    text = F.regexp_replace(text, r"[,.]+$", "")
    tokens = F.split(collapse_ws(text), " ")
    emoji = r"^[\x{1F001}-\x{10FFFF}]+$"
    words = F.filter(tokens, lambda w: ~w.rlike(emoji))
    faces = F.slice(F.filter(tokens, lambda w: w.rlike(emoji)), 1, 2)
    head = F.array_join(F.slice(words, 1, max_words), " ")
    head = F.when(head.endswith("..."), head).otherwise(F.concat(head, F.lit("...")))
    short = F.when(F.size(faces) > 0, F.concat(head, F.lit(" "), F.array_join(faces, " "))).otherwise(head)
    cleaned = F.when(text == "", F.lit(rules.REPLY_DEFAULT)).when(F.size(words) > max_words, short).otherwise(text)
    return F.when(col == "", col).otherwise(cleaned)


def relationship_tag(col: Column) -> Column:
    """Parent words are read before partner words; a partner with a spending verb is the happy case."""
    low = F.lower(col)
    partner = matches(low, rf"\b(?:{rules.PARTNER_WORDS})\b")
    return first_match([
        (matches(low, rf"\b(?:{rules.PARENT_WORDS})\b"), "PARENT"),
        (partner & matches(low, rf"\b(?:{rules.SPEND_WORDS})\b"), "PARTNER_SPEND"),
        (partner, "PARTNER"),
    ])


def sentiment(col: Column) -> Column:
    low = F.lower(col)
    return first_match([
        (contains_any(low, rules.POSITIVE_WORDS), "Positive"),
        (contains_any(low, rules.NEGATIVE_WORDS), "Negative"),
    ], "Neutral")


def emotion(intent: Column, category: Column, amount: Column) -> Column:
    alert = F.coalesce(category.contains("LIMIT") | category.contains("ALERT"), F.lit(False))
    return first_match([
        (intent == "Chitchat", "Happy"),
        ((intent == "Record") & F.coalesce(amount > 5_000_000, F.lit(False)), "Sad"),
        ((intent == "Record") & F.coalesce(category.isin("Entertainment", "Shopping"), F.lit(False)), "Happy"),
        ((intent == "Action") & alert, "Alert"),
    ], "Chill")


def asset_name(col: Column) -> Column:
    table = {**{a.lower(): a for a in rules.ASSETS}, **rules.PERSONAS}
    return lookup(F.lower(strip(col)), table)


def clean_product_words(col: Column) -> Column:
    return F.regexp_replace(F.lower(strip(col)), r"(?U)[^\w\s+]", "")


def short_name(col: Column) -> Column:
    """First two words, or one if the second is a filler."""
    words = F.filter(F.split(collapse_ws(clean_product_words(col)), " "), lambda w: w != "")
    second_is_filler = F.coalesce(F.get(words, F.lit(1)).isin(rules.SHORT_NAME_FILLERS), F.lit(False))
    return F.when(second_is_filler, F.get(words, F.lit(0))).otherwise(F.array_join(F.slice(words, 1, 2), " "))


def topic_label(col: Column) -> Column:
    low = F.lower(col)
    return first_match([(contains_any(low, words), label) for label, words in rules.TOPIC_LABELS], "Essentials")


def topic_variants(col: Column) -> Column:
    """The topic, short forms of the first key word it has, its accent-free form and a common misspelling, in that order."""
    low = F.lower(col)
    short = first_match([(low.contains(key), F.array(*map(F.lit, forms))) for key, forms in rules.ABBREVIATIONS.items()], F.array().cast("array<string>"))
    known = F.concat(F.array(strip(col)), short)
    plain = F.lower(strip_accents(col))
    plain = F.when(~F.exists(known, lambda x: F.lower(x) == plain), plain)
    typo = F.when(col.contains("sữa"), F.replace(col, F.lit("sữa"), F.lit("sửa")))
    return F.array_distinct(F.filter(F.concat(known, F.array(plain, typo)), lambda x: x.isNotNull() & (x != "")))


def short_topic_label(col: Column) -> Column:
    """Label of a short record's topic: key words in order, then food words, then beauty words."""
    low = F.lower(col)
    words = F.split(low, "[^a-zA-Z\\u00E0-\\u1EF90-9]+")
    food = contains_any(low, rules.SHORT_FOOD_TOPICS) | F.array_contains(words, "cf") | (F.array_contains(words, "hu") & F.array_contains(words, "tieu"))
    food = food | F.arrays_overlap(words, F.array(*map(F.lit, rules.SHORT_FOOD_WORDS)))
    cases = [(low.contains(key), label) for key, label in rules.SHORT_TOPIC_LABELS]
    return first_match([*cases, (food, "Food"), (contains_any(low, rules.SHORT_BEAUTY), "Beauty")], "Essentials")
