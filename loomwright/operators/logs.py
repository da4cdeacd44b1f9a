"""Streamed answers and their events, read back from logs of many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

_REPLY = "choices array<struct<delta struct<content string>>>"
#: What may follow what in the events of an answer: nothing yet, the meta event, a delta, the citations; after `over`, nothing.
FOLLOWS = {
    "begin": {"meta": "meta", "error": "over"},
    "meta": {"delta": "delta", "citations": "citations", "done": "over", "error": "over"},
    "delta": {"delta": "delta", "citations": "citations", "error": "over"},
    "citations": {"done": "over", "error": "over"},
}


def answers(lines: DataFrame, request: str = "request_id", order: str = "seq") -> DataFrame:
    """(request, answer, deltas, done) of lines(request, order, line): the contents of the deltas before the first `[DONE]`, in order.

    Lines that don't begin with `data:`, that aren't JSON, or that have no content are passed over. A log without
    `[DONE]` gives what it has. Only contents are gathered, and those after the end are dropped where requests are summed.
    """
    payload = strip(F.substring("line", 6, 1 << 30))
    data = F.col("line").startswith("data:")
    said = F.from_json(F.when(data & (payload != "[DONE]"), payload), _REPLY)["choices"]
    x = lines.select(request, order, F.when(data, payload == "[DONE]").otherwise(False).alias("_end"), F.when(F.size(said) > 0, said[0]["delta"]["content"]).alias("_text"))
    parts = F.collect_list(F.when(F.col("_text") != "", F.struct(F.col(order).alias("at"), F.col("_text").alias("text"))))
    g = x.groupBy(request).agg(F.min(F.when(F.col("_end"), F.col(order))).alias("_stop"), F.sort_array(parts).alias("_parts"))
    kept = F.filter("_parts", lambda p: F.col("_stop").isNull() | (p["at"] < F.col("_stop")))
    g = g.withColumn("_kept", kept)
    return g.select(request, F.array_join("_kept.text", "").alias("answer"), F.size("_kept").cast("long").alias("deltas"), F.col("_stop").isNotNull().alias("done"))


def _next(state: Column, kind: Column) -> Column:
    """The state after an event of that kind; null where it may not come."""
    out = F.lit(None).cast("string")
    for was, then in FOLLOWS.items():
        for k, to in then.items():
            out = F.when((state == was) & (kind == k), to).otherwise(out)
    return out


def event_faults(events: DataFrame, request: str = "request_id", order: str = "seq", kind: str = "type") -> DataFrame:
    """(request, events, fault) of each request: the place, from 0, of the first event that may not come there, the count of events where they end too soon, null where all is right."""
    g = events.groupBy(request).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(kind).alias("kind")))), lambda e: e["kind"]).alias("_kinds"))

    def step(a: Column, k: Column) -> Column:
        to = F.when(a["fault"].isNull(), _next(a["state"], k))
        bad = F.when(a["fault"].isNotNull(), a["fault"]).when(to.isNull(), a["at"])
        return F.struct((a["at"] + 1).alias("at"), F.coalesce(to, a["state"]).alias("state"), bad.alias("fault"))

    end = F.aggregate("_kinds", F.struct(F.lit(0).alias("at"), F.lit("begin").alias("state"), F.lit(None).cast("int").alias("fault")), step)
    x = g.select(request, F.size("_kinds").alias("n"), end.alias("e"))
    fault = F.coalesce(F.col("e.fault"), F.when(F.col("e.state") != "over", F.col("n")))
    return x.select(request, F.col("n").cast("long").alias("events"), fault.cast("long").alias("fault"))
