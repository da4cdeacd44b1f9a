"""A digest of rows in order that is put together from digests of their ranges."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digests are values of a polynomial at BASE modulo a prime.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """The (value, rows) of the rows of a and then those of b; (0, 0) is that of none."""
    return (a[0] * pow(BASE, b[1], PRIME) + b[0]) % PRIME, a[1] + b[1]


def row_value(text: str) -> int:
    """The first 15 hex digits of a row's SHA-256."""
    return int(sha256(text.encode()).hexdigest()[:15], 16)


def ordered_digest(rows: DataFrame, group: str, columns: list[str], order: list[str]) -> DataFrame:
    """(group, rows, digest) of the rows of each group in their order: any two that change places change it, how they are dealt does not.

    A row is its columns joined by bars, nulls as nothing. Rows are dealt and sorted by range of group and order, each
    task folds what it has of each group, and the pieces of a group, one a task at most, are put together.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    keys = [F.col("_group").asc_nulls_first(), *[F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]]
    x = rows.select(F.col(group).alias("_group"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], text.alias("_text"))
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_group", "_text")
    kind = rows.schema[group].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, now = TaskContext.get().partitionId(), [], None
        for b in batches:
            for g, t in zip(b["_group"].to_pylist(), b["_text"].to_pylist(), strict=True):
                one = (row_value(t), 1)
                if now and now[0] == g:
                    now = (g, joined(now[1], one))
                else:
                    held += [now] if now else []
                    now = (g, one)
        held += [now] if now else []
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], b_type), pa.array([part] * len(held), pa.int32()), pa.array([v for _, (v, _) in held], pa.int64()), pa.array([n for _, (_, n) in held], pa.int64())], names=["_group", "_part", "_value", "_rows"])

    from pyspark.sql.pandas.types import to_arrow_type

    b_type = to_arrow_type(rows.schema[group].dataType)
    pieces = x.mapInArrow(fold, f"_group {kind}, _part int, _value long, _rows long")

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        p, total = p.sort_values("_part"), (0, 0)
        for v, n in zip(p["_value"].tolist(), p["_rows"].tolist(), strict=True):
            total = joined(total, (v, n))
        return pd.DataFrame({group: p["_group"].iloc[:1], "rows": [total[1]], "digest": [total[0]]})

    return pieces.groupBy("_group").applyInPandas(whole, f"`{group}` {kind}, rows long, digest long")
