"""Predicates over receipt lines and boxes (F18, F20, F21, F33, F40, F45, J7, J8 rules, F39)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import rules
from tallyspark.functions import money
from tallyspark.functions.text import bind, contains_any, first_match, fold_marks, lookup, matches, strip

LETTER = "[a-zA-Zà-ỹÀ-Ỹ]"


def _numeric_line(line: Column) -> Column:
    compact = F.replace(line, F.lit(" "), F.lit(""))
    return (compact.rlike(r"^[0-9\s.,+\-/%]+$") | compact.rlike(r"^[0-9]{8,}$")
            | line.rlike(r"^\s*[0-9]+\s+[0-9.,]+\s+[0-9.,]+\s*$"))


def product_name(line: Column, score: Column | None = None) -> Column:
    """The product named by a line, NULL for headers, totals, discounts and number rows.

    ``score`` is the total score of the stripped line where the caller has it.
    """
    boilerplate = "|".join([rules.HEADER_SKIP, rules.SKIP_LINE, rules.TABLE_HEADER])

    def name_of(s: Column) -> Column:
        skip = ((F.length(s) < 3) | matches(s, boilerplate) | ((money.line_total_score(s) if score is None else score) >= 70)
                | matches(fold_marks(s), rules.DISCOUNT_LINE) | _numeric_line(s))
        cut = strip(F.regexp_replace(s, r"^\s*[0-9]+[\s.\-]+", ""))
        cut = strip(F.regexp_replace(cut, r"\s+[0-9]{1,3}(?:[.,][0-9]{3})+\s*$", ""))
        return F.when(~skip, bind(cut, usable))

    def usable(name: Column) -> Column:
        ok = (F.length(name) >= 3) & name.rlike(LETTER + "{2,}") & (
            name.rlike(LETTER + "{4,}") | (F.size(money.amounts_in_line(name)) == 0))
        return F.when(ok, name)

    return bind(strip(line), name_of)


def is_category_line(line: Column, score: Column | None = None) -> Column:
    """Product-like text: no boilerplate, totals or number rows."""
    s = strip(line)
    return ((F.length(s) >= 3) & ~matches(s, rules.HEADER_SKIP) & ~matches(s, rules.SKIP_LINE)
            & ((money.line_total_score(s) if score is None else score) < 70) & ~_numeric_line(s) & s.rlike(LETTER))


def brand_category(seller: Column) -> Column:
    low = fold_marks(seller)
    return first_match([(matches(low, pattern), category) for category, pattern in rules.BRANDS])


def merchant(line: Column) -> Column:
    low = fold_marks(line)
    return first_match([(matches(line, p) | matches(low, p), name) for name, p in rules.MERCHANTS])


def plausible_merchant(line: Column) -> Column:
    """A line that may name the shop when no known merchant is found."""
    s = strip(line)
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    ok = (~matches(s, rules.MERCHANT_SKIP) & ~s.rlike("^[0-9]+$") & F.length(s).between(3, 50)
          & (digits <= F.length(s) * 0.3))
    return F.when(ok, s)


def keyword_hits(text: Column) -> dict[str, Column]:
    """Lexicon keywords per category found in folded text."""
    return {cat: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
            for cat, words in rules.CATEGORY_KEYWORDS.items()}


def keyword_count(text: Column, words: list[str]) -> Column:
    """Number of the words found in folded text, as plain generated code."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def item_category(low: Column) -> Column:
    """Lexicon category of one folded item name (a column): struct(category, confidence).

    Every keyword of one line weighs the same, so counts decide; the first category wins ties.
    """
    ranked = F.array(*[F.struct(keyword_count(low, words).alias("s"), F.lit(-i).alias("i"), F.lit(cat).alias("c"))
                       for i, (cat, words) in enumerate(rules.CATEGORY_KEYWORDS.items())])
    return bind(F.array_max(ranked), lambda b: F.struct(
        F.when(b["s"] > 0, b["c"]).otherwise("Others").alias("category"), F.when(b["s"] > 0, 0.8).otherwise(0.5).alias("confidence")))


def canonical_category(label: Column, predicted: Column | None = None) -> Column:
    """A valid label stays; else prediction, alias, containment in either direction, Others."""
    low = fold_marks(label)
    exact = lookup(F.lower(strip(label)), rules.CATEGORY_ALIASES)
    inside = first_match([
        (F.contains(low, F.lit(vi)) | F.contains(F.lit(vi), low), en) for vi, en in rules.CATEGORY_ALIASES.items()])
    valid = F.when(label.isin(rules.RECEIPT_CATEGORIES), label)
    model = F.when(predicted.isin(rules.RECEIPT_CATEGORIES), predicted) if predicted is not None else F.lit(None)
    filled = F.when(F.coalesce(label, F.lit("")) != "", F.coalesce(valid, model, exact, inside))
    return F.coalesce(filled, F.lit("Others"))


def normalise_coord(value: Column, size: Column) -> Column:
    """0..1000 page coordinate, truncated."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), (1000 * value / size).cast("int")))


def fix_typo(label: Column) -> Column:
    clean = strip(label)
    return lookup(clean, rules.LABEL_TYPOS, clean)


def fix_entity_label(label: Column, text: Column) -> Column:
    """Typos, keyword rules (not for seller and address), numeric timestamps become totals."""
    start, low = fix_typo(label), F.lower(text)
    free = ~start.isin("SELLER", "ADDRESS")

    def has(words: list[str]) -> Column:
        return contains_any(low, words)

    worded = (F.when(free & has(rules.LABEL_TOTAL_WORDS), "TOTAL_COST")
              .when(free & has(rules.LABEL_TIME_WORDS), "TIMESTAMP").otherwise(start))
    return F.when((worded == "TIMESTAMP") & money.is_amount_token(text), "TOTAL_COST").otherwise(worded)


def receipt_confidence(amount: Column, backend: Column, seller: Column, timestamp: Column, warnings: Column) -> Column:
    base = F.when(backend == "heuristic", 0.82).otherwise(0.88)
    bonus = (F.when(F.coalesce(seller, F.lit("")) != "", 0.04).otherwise(0.0)
             + F.when(F.coalesce(timestamp, F.lit("")) != "", 0.03).otherwise(0.0))
    penalty = F.least(warnings * 0.03, F.lit(0.12))
    score = F.round(F.least(base + bonus - penalty, F.lit(0.97)), 4)
    return F.when(F.coalesce(amount, F.lit(0)) == 0, 0.3).otherwise(score)


def bill_label(category: Column, total: Column) -> Column:
    """Labeller answer made safe: unknown category is Others, the total keeps its digits."""
    return F.struct(F.when(category.isin(rules.RECEIPT_CATEGORIES), category).otherwise("Others").alias("bill_category"),
                    money.digits_only(total).alias("total_cost"))


def label_fixes(label: Column, text: Column) -> Column:
    """How many corrections ``fix_entity_label`` makes on the way."""
    raw, start, low = strip(label), fix_typo(label), F.lower(text)
    free = ~start.isin("SELLER", "ADDRESS")
    timed = free & contains_any(low, rules.LABEL_TIME_WORDS)
    total = free & contains_any(low, rules.LABEL_TOTAL_WORDS)
    after = F.when(timed, "TIMESTAMP").otherwise(start)
    final = F.when(total, "TOTAL_COST").otherwise(after)
    steps = [raw != start, timed & (start != "TIMESTAMP"), total & (after != "TOTAL_COST"),
             (final == "TIMESTAMP") & money.is_amount_token(text)]
    return sum((s.cast("int") for s in steps[1:]), steps[0].cast("int"))
