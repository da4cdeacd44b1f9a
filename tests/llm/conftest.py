import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps. It is a dog. " * 3, "en", "src1", None),
    (2, "", "en", "src1", 0),
    (3, None, None, None, None),
    (4, " \n\t ", "en", "src2", 4),
    (5, "Straße ÄÖ ſecret K élan 日本語 text ' s it's <|endoftext|> á x y z\x1cq", "de", "src2", 1),
    (6, LONG, "en", "src1", 2),
    (7, "The quick brown fox jumps. It is a dog. " * 3, "en", "src3", None),
    (8, "a b c a b c a b c\na b c a b c a b c\n\nx y", "en", "src3", 3),
    (9, "x" * 50_000, "en", "src1", 3),
    (9, "x" * 50_000, "en", "src1", 3),
    (None, "no id here at all", "en", "src1", 3),
    (12, "one two", "fr", "src9", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(ROWS, schema)
    names = (Path(__file__).parent.parent.parent / "loomwright" / "llm").glob("*.py")
    clash = {x for p in names for x in re.findall(r"""alias\("(\w+)"\)|withColumn\("(\w+)\"""", p.read_text()) for x in x if x} | {"_id", "_host", "_q", "_found", "_doc", "_cut", "_n", "row", "rid"}
    df = df.select("*", *[F.lit("clash").alias(c) for c in sorted(clash - {x.lower() for x in df.columns})])
    return df.repartition(3)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df):
    """(doc_id, text) of every row."""
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
