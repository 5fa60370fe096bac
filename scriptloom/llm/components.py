"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_folder, durable, scratch_folder

#: Tables of up to this many rows, counted first, are broadcast; larger ones are joined by shuffle.
#: Such tables hold at most five numbers a row, so this is a bound of about 4 MB.
BROADCAST_ROWS = 100_000
#: Edges that a task of a round handles: few edges are few tasks and files, whatever the session's partitions.
ROWS_A_TASK = 100_000
#: Bits of a map of ids for each of them, and its most bits.
ID_BITS, MOST_ID_BITS = 16, 1 << 30


def joined(left: DataFrame, right: DataFrame, on: str, rows: int, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side of ``rows`` rows: broadcast if that is small enough, else by shuffle.

    The other side may hold one key very often. So the shuffled way reads the right side from
    a written table: then both sides are plain exchanges, which adaptive execution can split.
    """
    return left.join(F.broadcast(right) if rows <= limit else durable(right), on, how)


def maybe_in(df: DataFrame, id_col: str, ids: DataFrame, count: int, outside: bool = False) -> DataFrame:
    """The rows whose id may be among ``count`` ids, or with ``outside`` those for which it cannot be.

    ids has the column ``id_col``. A bitmap of hashed ids, of 16 bits for each of them and at
    most 128 MB, is broadcast in pieces and looked up by a join on the piece, so no row of ``df``
    is shuffled and none is decided wrongly that an exact join does not see again. Null ids are
    in no table of ids.
    """
    bits = min(MOST_ID_BITS, max(1 << 15, 1 << (ID_BITS * max(1, count) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    parts = ids.where(F.col(id_col).isNotNull()).select(place(id_col).alias("p")).groupBy(F.expr("p div 32768").alias("_part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("_bits"))
    asked = df.withColumn("_p", place(id_col)).withColumn("_part", F.expr("_p div 32768"))
    there = asked.join(F.broadcast(durable(parts)), "_part", "left")
    byte = "cast(conv(hex(substring(_bits, cast((_p % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"{id_col} is not null and _bits is not null and (shiftright({byte}, cast(_p % 8 as int)) & 1) = 1")
    return there.where(~F.coalesce(hit, F.lit(False)) if outside else hit).select(df.columns)


def without(df: DataFrame, id_col: str, ids: DataFrame, count: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose id is not among ``count`` ids; rows with a null id stay.

    Few ids are broadcast. Of many a bitmap is, and only rows that it cannot decide are
    shuffled to the ids; the others pass.
    """
    if count <= limit:
        return df.join(F.broadcast(ids), id_col, "left_anti").select(df.columns)
    unsure = maybe_in(df, id_col, ids, count).join(durable(ids), id_col, "left_anti").select(df.columns)
    return maybe_in(df, id_col, ids, count, outside=True).unionByName(unsure)


def _large_star(edges: DataFrame, rows: int, limit: int) -> DataFrame:
    """(u, v) both ways; each neighbour above u goes to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return joined(both.where("v > u"), least, "u", 2 * rows, limit=limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int, limit: int) -> DataFrame:
    """u and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    turned = joined(down, least, "u", rows, limit=limit)
    return turned.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """((node, component), rows) of the nodes with an edge to another; component: smallest node.

    edges: (u, v) longs in any direction, repeated edges, loops and nulls allowed (loops and
    nulls are ignored). Nodes that are themselves the smallest of their component are not
    listed. Every half-step is shuffled with partial aggregation, and each round is written to
    the checkpoint folder, so a lost executor costs one round at most; when a round has been
    written, the one before is deleted.
    """
    spark = edges.sparkSession
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
    with scratch_folder(spark, "rounds") as folder:

        def written(df: DataFrame, k: int) -> DataFrame:
            df.write.parquet(f"{folder}/{k}")
            return spark.read.parquet(f"{folder}/{k}")

        now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
        was, is_now = None, mark(now)
        for k in count(1):
            if was == is_now or not is_now[0]:
                break
            rows = is_now[0]
            held = now.coalesce(-(-rows // ROWS_A_TASK))
            now = written(_small_star(_large_star(held, rows, limit), rows, limit).coalesce(-(-rows // ROWS_A_TASK)), k)
            delete_folder(spark, f"{folder}/{k - 1}")
            was, is_now = is_now, mark(now)
        return durable(now.select(F.col("u").alias("node"), F.col("v").alias("component"))), is_now[0]
