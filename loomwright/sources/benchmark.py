"""A retrieval benchmark of three Parquet tables: corpus, queries, and which documents answer which query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names and columns of the tables.
TABLES = {"corpus": {"id": "string", "text": "string"}, "queries": {"id": "string", "text": "string"}, "qrels": {"qid": "string", "pid": "string", "score": "double"}}


def read_benchmark(spark: SparkSession, folder: str, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """corpus(id, text), queries(id, text) and qrels(qid, pid, score) from Parquet in the folder; names has those of files that are called otherwise. Lacking columns are an error."""
    out = {}
    for table, kinds in TABLES.items():
        df = spark.read.parquet(f"{folder}/{(names or {}).get(table, table + '.parquet')}")
        lost = [c for c in kinds if c not in df.columns]
        if lost:
            raise ValueError(f"{table} has no {', '.join(lost)}")
        out[table] = df.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return out


def inverted(qrels: DataFrame, by: str, least: float = 0.0) -> DataFrame:
    """(by, ids, n): for each pid the qids that it answers, or for each qid its pids, each once and sorted, of qrels with a score above `least`."""
    other = {"pid": "qid", "qid": "pid"}[by]
    return qrels.where(F.col("score") > least).groupBy(by).agg(F.sort_array(F.collect_set(other)).alias("ids")).withColumn("n", F.size("ids").cast("long"))
