"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

A token budget flows down a tree of domain, language and source. At each node it is shared
among the children by weight. A child that cannot use its share, even by repeating its texts
for the allowed epochs, takes what it can and its siblings share the rest by weight; only what
all siblings together cannot use was kept by the parent's siblings, because a node never gets
more than its subtree can use. A leaf's budget becomes whole epochs and then a prefix, in the
seeded order of one further epoch, of as many texts as fit.

A text is read once for its number of words; what is decided about it rests on a written table
of ids, leaves and numbers. Texts are read again only where they are part of the result.

Prefixes need no sorted leaf: texts are dealt by the leading bits of their key into about
sqrt(texts) ranges, the ranges' sums show in which one the budget ends, and only that range is
ordered. So a leaf that holds a third of all rows costs a pre-aggregated sum and a window over
about sqrt(texts) rows. Rows of one id and length are one row of that window, with their number,
so an id that repeats without end is no long window either; where the budget ends between such
rows, their parts are counted and one part at most is numbered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

WORD = "[^\\x20\\x09-\\x0D]+"
#: Leaves up to this number and these bytes of names are broadcast to the texts; beyond it they are joined by shuffle.
BROADCAST_LEAVES, BROADCAST_NAMES = 50_000, 8_000_000
LEVELS = ("domain", "lang", "source")


def weight_of(column: Column, weights: dict[str, int], other: int) -> Column:
    """The whole-number weight of a name; ``other`` for names that the table lacks."""
    if not weights:
        return F.lit(float(other))
    table = F.create_map(*(F.lit(x) for name, w in sorted(weights.items()) for x in (name, float(w))))
    return F.coalesce(F.element_at(table, column), F.lit(float(other)))


def share_among(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``got``: each child's part of ``budget``, at most its ``cap``, by ``weight``.

    children: one row per child with parent columns, name, weight, cap, and budget, which is
    the same for all children of a parent. In the order of cap / weight the children that get
    their whole cap come first; the others share what these leave, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    return (
        children.withColumn("left_budget", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("rate", F.col("left_budget") / F.col("left_weight"))
        .withColumn("first_short", F.min(F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct("place", "rate"))).over(every))
        .withColumn("got", F.when(F.col("first_short").isNull() | (F.col("place") < F.col("first_short.place")), F.col("cap")).otherwise(F.floor(F.col("first_short.rate") * F.col("weight")).cast("double")))
        .drop("left_budget", "left_weight", "place", "rate", "first_short")
    )


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, other: int = 1) -> DataFrame:
    """(domain, lang, source, n_rows, tokens, got) from (domain, lang, source, n_rows, tokens).

    The whole budget is ``percent`` hundredths of all tokens, or what the tree can use.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    total = float((leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100)
    parents: list[str] = []
    given = None
    for depth, name in enumerate(LEVELS):
        keys = [*LEVELS[: depth + 1]]
        children = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col(name), weights.get(name, {}), other))
        children = children.join(given, parents) if parents else children.withColumn("budget", F.lit(total))
        given = share_among(children, parents, name).select(*keys, F.col("got").alias("budget"))
        parents = keys
    return leaves.drop("cap").join(given.withColumnRenamed("budget", "got"), [*LEVELS])


def edge_rows(edge: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of the ranges in which budgets end, with _taken.

    numbers: the same rows without their payload. Rows of one leaf, key, id and length are
    counted, and the window runs over these counts. Of each leaf the budget ends among the equal
    rows of one id at most.
    """
    same = [*LEVELS, "_key", "_id", "n_tokens"]
    order = Window.partitionBy(*LEVELS).orderBy("_key", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    equal = numbers.groupBy(*same).agg(F.count(F.lit(1)).alias("_rows"), F.min("rest").alias("rest"), F.min("end_ahead").alias("end_ahead"))
    room = F.col("rest") - F.col("end_ahead") - F.coalesce(F.sum(F.col("_rows") * F.col("n_tokens")).over(order), F.lit(0))
    fit = F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0), F.least("_rows", F.expr("_room div n_tokens")))).otherwise(F.when(F.col("_room") >= 0, F.col("_rows")).otherwise(0))
    decided = durable(equal.withColumn("_room", room).withColumn("_fit", fit).select(*same, "_rows", "_fit"))
    met = [edge[c].eqNullSafe(decided[c]) for c in same]
    rows = edge.join(decided, met).select(*(edge[c] for c in edge.columns), "_rows", "_fit")
    clear = rows.where("_fit = 0 or _fit = _rows").withColumn("_taken", F.col("_fit") > 0)
    if not decided.where("_fit > 0 and _fit < _rows").limit(1).count():
        return clear.drop("_rows", "_fit")
    split = durable(rows.where("_fit > 0 and _fit < _rows").withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    ahead = Window.partitionBy(*LEVELS).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(split.groupBy(*LEVELS, "_part").agg(F.count(F.lit(1)).alias("_held")).withColumn("_ahead", F.coalesce(F.sum("_held").over(ahead), F.lit(0))))
    placed = split.join(parts, [*LEVELS, "_part"])
    whole = placed.where("_ahead >= _fit or _ahead + _held <= _fit").withColumn("_taken", F.col("_ahead") < F.col("_fit"))
    number = F.row_number().over(Window.partitionBy(*LEVELS).orderBy("_row"))
    one = placed.where("_ahead < _fit and _ahead + _held > _fit").withColumn("_taken", F.col("_ahead") + number <= F.col("_fit"))
    return clear.unionByName(whole.unionByName(one).select(clear.columns)).drop("_rows", "_fit")


def mix(
    df: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    percent: int,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    payload: list[str] | None = None,
    limit: int = BROADCAST_LEAVES,
) -> DataFrame:
    """(id_col, domain, lang, source, n_tokens, epoch, *payload), a row for each epoch that takes a text.

    Tokens are words between white space. Null domains, languages and sources are the name '';
    null and empty texts have no tokens and belong to every prefix before which budget is left
    over. A prefix never passes its budget. Order in an epoch is md5(seed:epoch:id), then the
    id, then the number of tokens; rows that tie in all are told apart in the order found, so
    any of them may be taken. Null ids form one key like any other. A leaf without tokens keeps its rows once
    if its budget is not used up by others. An empty table gives no rows. Columns not named
    are ignored. More than ``limit`` leaves meet their texts by shuffle, with the same result.
    """
    extra = payload or []
    own = (
        F.col(id_col).alias("_id"),
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    texts = durable(df.select(*own))
    leaves = texts.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").cast("double").alias("tokens"))
    budgets = (
        leaf_budgets(durable(leaves), weights, percent, max_epochs)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("got") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("got") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0.0)).cast("long"))
        .withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_rows")))).cast("int"))
        .select(*LEVELS, "whole", "rest", "ranges")
    )
    budgets = durable(budgets)
    number, names = budgets.agg(F.count(F.lit(1)), F.sum(sum((F.octet_length(c) for c in LEVELS), F.lit(0)))).first()
    few = number <= limit and (names or 0) <= BROADCAST_NAMES
    held = F.broadcast if few else (lambda x: x)

    def keyed(rows: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))
        at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return rows.withColumn("_key", key).withColumn("_range", F.floor(at * F.col("ranges")).cast("int"))

    sums = keyed(texts.select(*LEVELS, "_id", "n_tokens").join(held(budgets), [*LEVELS])).where("rest > 0").groupBy(*LEVELS, "rest", "_range").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
        .where("ahead + held > rest")
        .groupBy(*LEVELS)
        .agg(F.min(F.struct("_range", "ahead")).alias("end"))
        .select(*LEVELS, F.col("end._range").alias("end_range"), F.col("end.ahead").alias("end_ahead"))
    )
    plan = durable(budgets.join(ends, [*LEVELS], "left"))
    whole = df.select(*own, *(F.col(c).alias(f"_p{i}") for i, c in enumerate(extra))) if extra else texts
    rows = keyed(whole.join(held(plan), [*LEVELS]))
    inside = F.col("_range") == F.col("end_range")
    edge = rows.where((F.col("rest") > 0) & inside)
    in_range = edge_rows(edge, keyed(texts.join(held(plan), [*LEVELS])).where((F.col("rest") > 0) & inside))
    others = rows.where((F.col("rest") <= 0) | F.col("end_range").isNull() | ~inside).withColumn("_taken", (F.col("rest") > 0) & (F.col("end_range").isNull() | (F.col("_range") < F.col("end_range"))))
    copies = F.col("whole") + F.col("_taken").cast("int")
    return (
        others.unionByName(in_range)
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .select("_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch"), *(f"_p{i}" for i in range(len(extra))))
        .withColumnsRenamed({"_id": id_col} | {f"_p{i}": c for i, c in enumerate(extra)})
    )
