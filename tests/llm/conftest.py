import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size string, row string, n string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéöü") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, near copies, odd white space."""
    long = words(1, 4000)
    base = words(2, 60).split()
    near = [" ".join(w if i != k * 7 else "zz" for i, w in enumerate(base)) for k in range(4)]
    texts = ["", None, " \t\n ", "a", "one two three", long, long, long.replace(" ", "\n", 30), *near, near[0], near[0] + " ",
             "line one is long enough here\nline two is long enough here\nline one is long enough here",
             "line one is long enough here!\nshort\nline  two is long enough here\r", "x" * 5000, "tab\tand\x0bvertical  spaces\n\n\nend",
             "AKIA" + "B" * 16 + " password: hunter22 " + "0a1b" * 8, "mail a.b@c.org or +1 (017) 555-7713, 4736962573099581, 10.0.0.1", "𝒳é ü 中文 a@b.co"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(3, "a", "en", "s1", 1), (None, "no id at all, but words", None, None, 3), (None, near[0], "en", "s0", 1), (-5, near[1], "en", "s9", 1)]
    return [(*r, "k", "s", "r", "n") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows as a table of files, and an empty one of the same schema."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/rows")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none")
    return spark.read.parquet(f"{path}/rows"), spark.read.schema(SCHEMA).parquet(f"{path}/none")
