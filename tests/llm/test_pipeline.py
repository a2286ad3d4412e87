"""The pipeline's stages against plain versions, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tallyspark.llm import quality
from tallyspark.llm.common import written

from .conftest import words
from .test_operators import brute_components, brute_lines, counts, edited, ids, split


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        text = "\n".join([words(i * 9, rng.randint(8, 30)), rng.choice([words(3, 9), words(4, 9), words(i, 9)]), words(i * 9 + 1, rng.randint(10, 60))])
        rows.append((i, text))
    rows += [(200 + i, edited(rows[i][1], 1, rng)) for i in range(15)] + [(300 + i, rows[i][1]) for i in range(5)]
    rows += [(400, "too short"), (401, " ".join(["again and again we say the very same words"] * 9)), (402, None), (403, "")]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or ""), "x") for i, t in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more string").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(pipeline.STAGES)
    step = lambda name, df: written(stages[name](spark, df, folder), name)

    kept = step("quality_rules", docs)
    assert kept.columns == list(pipeline.COLUMNS)
    verdict = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert plain(kept) == {i: t for i, t in plain(docs).items() if verdict[i]}
    assert all(counts(t)[0] >= 20 for t in plain(kept).values()) and 401 not in plain(kept)

    single = step("line_dedup", kept)
    want = {r[0]: t for r, t in brute_lines(list(plain(kept).items())).items()}
    assert plain(single) == {i: t for i, t in want.items() if split(t) or t == plain(kept)[i]}
    assert single.columns == list(pipeline.COLUMNS) and single.filter(F.length("text") != F.col("n_chars")).count() == 0

    apart = step("near_copies", single)
    roots = brute_components(list(plain(single).items()))
    assert plain(apart) == {i: t for i, t in plain(single).items() if roots[i] == i}

    mixed = step("mix_sources", apart)
    sizes = {r.source: r.n for r in apart.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes) and all(taken[s] <= 3 * sizes[s] for s in sizes)
    assert all(any(t.startswith(r.text) for t in [plain(apart)[r.doc_id]]) for r in mixed.collect())

    packed = step("pack", mixed).collect()
    assert sum(r.length for r in packed) == sum(len(ids(r.text)) for r in mixed.collect())


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0
