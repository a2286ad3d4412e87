"""Personal data by patterns, and terms that reveal it by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import bind
from tallyspark.llm.common import bounded_broadcast, written
from tallyspark.llm.spans import count_of, find, find_blocks, labelled, placed, written_out

# The kinds and their base patterns. The look-behinds keep a search from starting inside a run it has
# already tried; a match is the same without them. Repeated groups are possessive: they cannot give anything back, and
# Java runs them as a loop where it would else call itself once per repeat.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TERM = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
MIN_LETTERS = 4
#: Bits of evidence a pair needs: its different contexts (copies repeat a context), each worth the term's information in
#: the whole corpus. So a term of one document in 4 096 counts at once, a common one only from several contexts.
EVIDENCE = 12.0
#: Share of an entity's information that a term gives away: from here on generalised, from there on removed.
GENERALISE = 0.6
REMOVE = 0.9
#: Hashes of revealing terms that may be broadcast, so that only words that agree with one are dealt out to be marked;
#: with more of them all words are.
MARKED_TERMS = 2_000_000


def _luhn(digits: Column) -> Column:
    """The check sum holds: every second digit from the right is doubled."""
    def worth(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base spans by kind as listed, then start."""
    digits = lambda s: F.regexp_replace(s.match, "[^0-9]", "")
    counted = lambda s, low, high: F.length(digits(s)).between(low, high)
    octet = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(part, F.lit("0")), F.lit("999")), F.lit(0)) <= 255)
    return F.concat(
        labelled(find(text, EMAIL), "email", 0),
        labelled(F.filter(find(text, IP), lambda s: F.forall(F.split(s.match, r"\."), octet)), "ip", 1),
        labelled(F.filter(F.filter(_long_enough(text), lambda s: counted(s, 16, 19)), lambda s: _luhn(digits(s))), "card", 2),
        labelled(F.filter(find(text, PHONE), lambda s: counted(s, 8, 15)), "phone", 3))


def _long_enough(text: Column) -> Column:
    """Digit runs, looked for only in a text that has one of 16 digits."""
    return F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), find(text, CARD)).otherwise(find(F.lit(None).cast("string"), CARD))


def entity_keys(base: Column) -> Column:
    """The protected entities of a text, hashed: kind and value of each base span, and what values share: the local
    part and the domain of an e-mail, the first three numbers of an address."""
    key = lambda kind, value: F.xxhash64(F.lit(kind), F.lower(value))
    part = lambda kind, name, pattern: F.transform(F.filter(base, lambda s: s.kind == kind), lambda s: key(name, F.regexp_extract(s.match, pattern, 1)))
    return F.array_distinct(F.concat(
        F.transform(base, lambda s: F.xxhash64(s.kind, F.lower(s.match))), part("email", "local", "^(.*)@"), part("email", "domain", "@(.*)$"),
        part("ip", "network", r"^(.*)\.[0-9]+$")))


def words_at(text: Column) -> Column:
    """Terms of a text with their places, as an array of (``start``, ``end``, ``match``)."""
    return find(text, TERM, 16)


def entity_terms(entities: DataFrame) -> DataFrame:
    """Rows (``row``, ``term``, ``context``): the different terms of every text with entities, each once.

    Words that touch a base span are no terms. The context is what stands around the term, at the place where its hash is
    smallest, so copies of a passage repeat it. Neighbours are set beside each word before the words become rows: no row
    carries the text's other words.
    """
    none = F.array(F.lit(None).cast("string"))

    def beside(words):
        match = F.transform(words, lambda w: F.lower(w.match))
        return bind(match, lambda m: F.zip_with(
            F.zip_with(words, m, lambda w, term: F.struct(w.start.alias("start"), w.end.alias("end"), term.alias("term"))),
            F.zip_with(F.concat(none, m), F.concat(F.slice(m, F.lit(2), F.size(m)), none), lambda before, after: F.xxhash64(before, after)),
            lambda w, context: F.struct(w.start.alias("start"), w.end.alias("end"), w.term.alias("term"), context.alias("context"))))

    free = lambda w: (F.length(w.term) >= MIN_LETTERS) & ~F.exists("base", lambda b: (b.start < w.end) & (w.start < b.end))
    found = entities.select("row", F.explode(F.filter(bind(words_at(F.col("text")), beside), free)).alias("w"))
    return found.select("row", "w.term", "w.context").groupBy("row", "term").agg(F.min("context").alias("context"))


def marked_words(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``row``, ``term``, ``start`` and ``end`` of the words whose hash is in ``marks``; only their places are measured."""
    blocks = rows.select("row", F.explode(find_blocks(F.col("text"), TERM)).alias("b")).select("row", "b.*")
    words = blocks.select("*", F.posexplode("found").alias("i", "match")).withColumn("term", F.lower("match"))
    words = words.join(F.broadcast(marks), F.xxhash64("term") == F.col("mark"), "left_semi")
    start = placed(F.col("at"), F.col("found"), F.col("pieces"), F.col("i"))
    words = words.select("row", "term", start.alias("start"), F.length("match").alias("_n"))
    return words.select("row", "term", "start", (F.col("start") + F.col("_n")).alias("end"))


def document_counts(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``term`` and ``n_term``, the documents of the whole corpus that hold it outside base spans."""
    plain = rows.filter(F.size("base") == 0).select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    return plain.filter(F.length("term") >= MIN_LETTERS).union(near.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def revealing_terms(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``term`` and ``share``: the largest share of an entity's information that the term gives away, where it reaches
    ``GENERALISE``: pointwise mutual information over self-information, from document frequencies of the whole corpus.

    A pair needs ``EVIDENCE``: the number of its different neighbourhoods, times the information of the term. So a pair
    of one document counts if the term is rare in the whole corpus, and copies of a passage neither help nor harm it.
    Terms too common for the share are left out before pairs are
    made. Every count is combined in the map tasks first.
    """
    total = rows.count()
    holders = rows.filter(F.size("base") > 0).select("row", F.explode(entity_keys(F.col("base"))).alias("entity")).distinct()
    n_entity = written(holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entity-counts")
    # A term in n_both <= n_entity documents reaches the share only below this many documents.
    cap = F.lit(float(total)) * F.pow(F.col("n_entity") / F.lit(float(total)), F.lit(GENERALISE))
    shared = written(n_entity.filter("n_entity > 1"), "entities-shared")
    holders = holders.join(bounded_broadcast(shared), "entity", "left").withColumn("n_entity", F.coalesce("n_entity", F.lit(1)))
    # Entities that stand in one document only, and in the same one, have the same counts: one stands for all.
    holders = holders.withColumn("entity", F.when(F.col("n_entity") > 1, F.col("entity"))).groupBy("row", "entity").agg(F.max("n_entity").alias("n_entity"))
    holders = holders.withColumn("cap", cap).groupBy("row").agg(F.collect_list(F.struct("entity", "n_entity", "cap")).alias("of"), F.max("cap").alias("cap"))
    most = holders.agg(F.max("cap")).first()[0] or 0.0
    rare = document_counts(rows, near).filter(F.col("n_term") <= F.lit(most * (1 + 1e-9)))
    pairs = near.join(rare, "term").join(holders, "row").select("row", "term", "context", "n_term", F.explode("of").alias("e"))
    pairs = pairs.filter(F.col("n_term") <= F.col("e.cap") * (1 + 1e-9)).select(
        "row", "term", "context", "n_term", F.coalesce("e.entity", F.col("row")).alias("entity"), F.col("e.n_entity").alias("n_entity"))
    # Different contexts per pair without a distinct count: first one row per context, then one per pair.
    by_context = pairs.groupBy("entity", "term", "n_entity", "n_term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = by_context.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n_both"))
    joint = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    enough = F.col("contexts") * F.log2(F.lit(float(total)) / F.col("n_term")) >= EVIDENCE
    pairs = pairs.filter(enough).select("term", F.when(own > 0, joint / own).otherwise(0.0).alias("share"))
    return pairs.filter(F.col("share") >= GENERALISE).groupBy("term").agg(F.max("share").alias("share"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row of ``docs`` (``doc_id``, ``text``).

    Protected entities are the base spans (e-mail, address, card and phone patterns). If the corpus says that a term of
    a document with an entity reveals it, every occurrence of the term in every text, with or without the entity, is
    added as a span ``term`` (to be generalised) or ``drop`` (to be removed); see ``revealing_terms``. Base spans always
    stay, and no added span touches one. ``redacted`` writes the spans into the text.

    Null text: no spans. Rows are told apart by their place in the scan, so null and repeated ids are no matter. A text of
    any length is searched whole; patterns run as loops, so long chains of short words cost no stack. Other columns are
    ignored. An empty table gives an empty result. Python is not used.
    """
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(F.array(base_spans(text))).alias("base"), text)
    rows = written(rows, "entities")
    near = written(entity_terms(rows.filter(F.size("base") > 0)), "near")
    shares = written(revealing_terms(rows, near), "shares")
    marks = written(shares.select(F.xxhash64("term").alias("mark")).distinct(), "marks")
    if marks.limit(MARKED_TERMS + 1).count() <= MARKED_TERMS:
        found = marked_words(rows, marks)
    else:
        found = rows.select("row", F.explode(words_at(text)).alias("w")).select("row", F.lower("w.match").alias("term"), "w.start", "w.end")
    added = found.join(shares, "term")
    kind = F.when(F.col("share") >= REMOVE, F.struct(F.lit(5).alias("place"), F.lit("drop").alias("kind"))).otherwise(
        F.struct(F.lit(4).alias("place"), F.lit("term").alias("kind")))
    added = added.withColumn("k", kind).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k.place", "k.kind", "start", "end"))).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s.place, s.kind, s.start, s.end))
    free = F.filter("added", lambda s: ~F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end)))
    spans = F.concat(plain, F.coalesce(free, F.array().cast(added.schema["added"].dataType)))
    return rows.join(added, "row", "left").select("row", "doc_id", "base", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with base spans as ``[KIND]``, revealing terms as ``[TERM]``, and terms to be removed left out.

    Of spans that overlap, the one that starts first is written, then the longer one.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.kind.alias("kind"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done, s):
        mark = F.when(s.kind == "drop", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s.kind), F.lit("]")))
        before = F.substring(text, done.at.cast("int") + 1, (s.start - done.at).cast("int"))
        return F.when(s.start < done.at, done).otherwise(F.struct((-s.back).alias("at"), F.concat(done.out, before, mark).alias("out")))

    return bind(F.aggregate(ordered, first, step), lambda done: F.concat(
        done.out, F.substring(text, done.at.cast("int") + 1, F.length(text))))


def report(found: DataFrame) -> DataFrame:
    base = F.col("base")
    return found.select(
        "doc_id", *[count_of(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_terms"))
