"""Which of overlapping proposals to follow: the set of spans without overlap that weighs most.

Layers propose spans of words with a confidence. Spans that overlap, directly or through others,
are one cluster, found by a running maximum; clusters are solved apart, so a long recording is
many small rows. In a cluster, spans are taken in the order of their last word, then first word,
layer and reason, and for each the better of two sums is kept: without it, or with it and the best
of those that end before it begins. Where both weigh the same, it is left out.

Spans with a null recording, place or weight, with a weight of 0 or less, and that end before they
begin are left out. Equal spans are one. Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

SPAN = ("last_idx", "first_idx", "layer", "reason", "weight")


def heaviest(spans: list[tuple[int, int, int]]) -> list[int]:
    """Places of the chosen spans (last, first, weight), which are in order."""
    ends = [s[0] for s in spans]
    best, before = [0], []
    for _, first, weight in spans:
        before.append(bisect_left(ends, first))
        best.append(max(best[-1], weight + best[before[-1]]))
    chosen, k = [], len(spans)
    while k:
        if spans[k - 1][2] + best[before[k - 1]] > best[k - 1]:
            chosen.append(k - 1)
            k = before[k - 1]
        else:
            k -= 1
    return chosen[::-1]


def without_overlap(spans: DataFrame) -> DataFrame:
    """(stream_id, first_idx, last_idx, layer, reason, weight): the chosen ones.

    spans: the same columns; weight is a whole number, such as hundredths of a confidence times words.
    """
    sound = spans.where("stream_id is not null and first_idx <= last_idx and weight > 0").select("stream_id", *(F.col(c).cast("string" if c in ("layer", "reason") else "long").alias(c) for c in SPAN)).distinct()
    order = Window.partitionBy("stream_id").orderBy("first_idx", *(c for c in SPAN if c != "first_idx"))
    reach = F.max("last_idx").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = sound.withColumn("_new", F.coalesce(F.col("first_idx") > reach, F.lit(True)).cast("long"))
    clusters = marked.withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("stream_id", "_cluster").agg(F.array_sort(F.collect_list(F.struct(*SPAN))).alias("spans"))
    kind = clusters.schema["stream_id"].dataType.simpleString()
    names = ("first_idx", "last_idx", "layer", "reason", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for stream, held in zip(batch["stream_id"].to_pylist(), batch["spans"].to_pylist()):
                for k in heaviest([(x["last_idx"], x["first_idx"], x["weight"]) for x in held]):
                    for column, value in zip(out, (stream, *(held[k][c] for c in names))):
                        column.append(value)
            types = (batch.schema.field("stream_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], ["stream_id", *names])

    ship_package(spans.sparkSession)
    return clusters.select("stream_id", "spans").mapInArrow(run, f"stream_id {kind}, first_idx long, last_idx long, layer string, reason string, weight long")
