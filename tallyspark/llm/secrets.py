"""Secret scans with corpus-wide ownership: how many owners and repositories hold a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.llm.spans import count_of, find, labelled, written_out

# The base patterns. Letters of the keywords count in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")

#: Long runs without a keyword; they need letters of both cases and a digit.
BLOB = r"[A-Za-z0-9+/_=-]{32,}"
#: A value of at least so many owners or repositories counts as a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 5


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind. Runs of hex digits or capitals are whole runs, so the shortest length may stand in the pattern."""
    value = lambda s: F.regexp_extract(s.match, ASSIGNED, 1)
    parts = [
        labelled(F.filter(find(text, ASSIGN), lambda s: F.length(value(s)) >= 6), "assign", 0),
        labelled(find(text, r"AKIA[A-Z0-9]{16,}"), "access", 1),
        labelled(find(text, r"[0-9a-f]{24,}"), "hex", 2),
    ]
    by_start = lambda s: F.struct(s.start, s.place, s.kind, s.end, s.match)
    return F.transform(F.array_sort(F.transform(F.concat(*parts), by_start)), lambda s: F.struct(s.place, s.kind, s.start, s.end, s.match))


def blob_spans(text: Column, base: Column) -> Column:
    """Long mixed runs that touch no base span."""
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    free = lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end))
    return labelled(F.filter(F.filter(find(text, BLOB), lambda s: mixed(s.match)), free), "blob", 3)


def ownership(candidates: DataFrame, owners: int = EXAMPLE_OWNERS, repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Per ``digest`` its ``n_owners``, ``n_repos`` and ``verdict`` (``live`` or ``example``).

    Rows shrink to (digest, owner, repository) in the map tasks, then to one row per owner, so a value that stands in
    a third of all rows never meets in one task.
    """
    single = candidates.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("_n"))
    by_owner = single.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("_repos"))
    counted = by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("_repos").alias("n_repos"))
    copied = (F.col("n_owners") >= owners) | (F.col("n_repos") >= repos)
    return counted.withColumn("verdict", F.when(copied, "example").otherwise("live"))


def scan_secrets(docs: DataFrame, owner: Column | None = None, repo: Column | None = None,
                 owners: int = EXAMPLE_OWNERS, repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``doc_id``, ``base`` (base spans), ``judged`` (every candidate with ``verdict``, ``n_owners``, ``n_repos``).

    ``owner`` and ``repo`` default to the source and to source and language. Candidates are the values of base spans
    and long mixed runs; the corpus decides by owners and repositories whether a value is a copied example or looks
    live. Values leave the scan as SHA-256 digests only.

    Null text: no spans. Null owners or repositories count as one of their own. Rows are told apart by their place in
    the scan, so null, equal and repeated ids are no matter. A text of any length is searched whole; a value that stands
    in it many times counts once for its owner. Other columns are ignored. An empty table gives an empty result. Python is
    not used.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.struct("source", "lang") if repo is None else repo
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.alias("owner"), repo.alias("repo"),
                       F.explode(F.array(base_spans(text))).alias("base"), text)
    digest = lambda s: F.unhex(F.sha2(F.when(s.kind == "assign", F.regexp_extract(s.match, ASSIGNED, 1)).otherwise(s.match), 256))
    hidden = lambda spans: F.transform(spans, lambda s: F.struct(s.place, s.kind, s.start, s.end, digest(s).alias("digest")))
    rows = written(rows.select("row", "doc_id", "owner", "repo", hidden("base").alias("base"),
                               hidden(blob_spans(text, F.col("base"))).alias("blobs")), "secrets")
    candidates = rows.select("row", "owner", "repo", F.explode(F.concat("base", "blobs")).alias("s")).select("*", "s.digest")
    judged = candidates.join(ownership(candidates, owners, repos), "digest").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.place", "s.kind", "s.end", "verdict", "n_owners", "n_repos"))).alias("judged"))
    return rows.join(judged, "row", "left").select(
        "doc_id", "base", F.coalesce("judged", F.array().cast(judged.schema["judged"].dataType)).alias("judged"))


def report(scanned: DataFrame) -> DataFrame:
    """Digest columns of a scan: base counts, hash of the base spans, all spans (base ones, and blobs that look live)."""
    base = F.col("base")
    spans = F.filter("judged", lambda s: (s.place < 3) | (s.verdict == "live"))
    judged = lambda verdict: F.size(F.filter("judged", lambda s: s.verdict == verdict)).cast("long")
    return scanned.select(
        "doc_id", *[count_of(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written_out(base), 256).alias("base_sha256"), written_out(spans).alias("spans"),
        *[judged(v).alias(f"n_{v}") for v in ("live", "example")])


def _duck_spans(kind: str, place: int, pattern: str, keep: str) -> str:
    return rf"""
  SELECT row, doc_id, source, lang, {place} AS place, '{kind}' AS kind, start, start + length(m) AS "end", m FROM (
    SELECT row, doc_id, source, lang, unnest(f) AS m,
           unnest(list_transform(range(1, len(f) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))) AS start
    FROM (SELECT row, doc_id, source, lang, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS p FROM d)
  ) WHERE {keep}"""


_KEY = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?"""
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, lang, text FROM documents),
base AS ({_duck_spans("assign", 0, _KEY + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_KEY}([A-Za-z0-9+/_.=-]+)$', 1)) >= 6")}
 UNION ALL {_duck_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
 UNION ALL {_duck_spans("hex", 2, "[0-9a-f]+", "length(m) >= 24")}),
blob AS (SELECT * FROM ({_duck_spans("blob", 3, "[A-Za-z0-9+/_=-]{32,}", "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")}) b
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.row = b.row AND base.start < b."end" AND b.start < base."end")),
c AS (SELECT *, sha256(CASE WHEN kind = 'assign' THEN regexp_extract(m, '^{_KEY}([A-Za-z0-9+/_.=-]+)$', 1) ELSE m END) AS digest
      FROM (SELECT * FROM base UNION ALL SELECT * FROM blob)),
o AS (SELECT digest, count(DISTINCT coalesce(source, '-none-')) AS n_owners,
             count(DISTINCT (coalesce(source, '-none-'), coalesce(lang, '-none-'))) AS n_repos FROM c GROUP BY digest),
j AS (SELECT c.*, CASE WHEN n_owners >= 3 OR n_repos >= 5 THEN 'example' ELSE 'live' END AS verdict FROM c JOIN o USING (digest)),
g AS (SELECT row, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS k, count(*) FILTER (place = 2) AS h,
             string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) FILTER (place < 3) AS base,
             string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) FILTER (place < 3 OR verdict = 'live') AS spans,
             count(*) FILTER (verdict = 'live') AS live, count(*) FILTER (verdict = 'example') AS example FROM j GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example
FROM d LEFT JOIN g USING (row)
"""
