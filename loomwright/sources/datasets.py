"""Evaluation data from JSON and JSON lines: samples with their gold, relevance maps, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a sample. Unknown fields are left out; missing ones are null.
SAMPLE = (
    "id string, task string, query string, history array<struct<role:string,content:string>>, "
    "gold struct<documents:array<struct<document_id:string,relevance:double,spans:array<struct<start:int,`end`:int>>>>,chunks:array<string>,answers:array<string>,`values`:array<string>,behavior:string>, "
    "metadata map<string,string>"
)
SPANS = "query string, relevant_spans array<struct<start:int,`end`:int>>"


def read_samples(spark: SparkSession, path: str, lines: bool = True, schema: str = SAMPLE) -> DataFrame:
    """A row for each sample of JSON lines, or of JSON files that hold an array each. Broken lines raise an error."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)


def gold_documents(samples: DataFrame) -> DataFrame:
    """(id, document_id, relevance, spans): the documents that answer each sample; a missing relevance is 1."""
    d = samples.select("id", F.explode("gold.documents").alias("d"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return d.select("id", "d.document_id", F.coalesce("d.relevance", F.lit(1.0)).alias("relevance"), F.coalesce("d.spans", none).alias("spans"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, document_id, relevance) of JSON files that map queries to documents and these to their relevance; a list of documents counts 1 each."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "said"))
    mapped = each.select("query_id", F.explode(F.from_json("said", "map<string,double>")).alias("document_id", "relevance")).where("relevance is not null")
    listed = each.where(F.col("said").startswith("[")).select("query_id", F.explode(F.from_json("said", "array<string>")).alias("document_id"), F.lit(1.0).alias("relevance"))
    return mapped.unionByName(listed)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of the top fields of JSON files, values as JSON."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
