"""Near-duplicate documents: MinHash with banding, exact confirmation, connected components.

A document is the set of its word shingles. Documents with equal sets are one class, found by
the digest of the set. For each class many universal hash functions give the minima of the
set; bands of minima are bucket keys. Buckets with the same members count once. Classes that
buckets connect form a group, or, where comparing all of a group would be more work than
comparing the members of each of its buckets, each bucket is a group of its own.

A group is cut into chunks and compared in two rounds, always on full sets, as a product of
sparse columns taken in slices. First every chunk is compared with itself and with the first
chunk, which in a group of near copies joins nearly all. Then only classes that are still in
different components are looked at: their signatures rule out most pairs, and the full sets of
the rest are compared. So a class is sent twice in the first round, whatever the size of its
group, a block returns a spanning forest of its links and never pairs, and no link that could
join two components is lost, but for those that signatures rule out wrongly: a pair at the
threshold is that with a probability of about 3 in a million (4.5 standard deviations), in the
second round alone. Which pairs beyond those of a common bucket are compared depends on the
group: more than banding promises, never fewer. The forests join components by large-star and
small-star.

Full sets are made again from the text, for members of groups alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import MIX_A, MIX_B, MIX_C, as_bytes, ascii_words, hash_tokens, map_arrow, non_empty, ship_package
from .components import BROADCAST_ROWS, components, joined, maybe_in

#: A group is cut into chunks of about this many classes; two chunks are a block.
BLOCK = 128
#: Bytes of the sets of a chunk, about: a group of long documents is cut into more chunks.
BLOCK_BYTES = 64 << 20
#: Columns of the membership matrix that are multiplied at once.
SLICE = 4096
#: Chunks in which signatures are compared.
SIG_BLOCK = 1024
SEED = 20_240_229


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words: the whole as one."""
    words = ascii_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = hash_tokens(words)
    span = min(n, width)
    mixed = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        mixed = (mixed ^ h[j : n - span + 1 + j]) * MIX_A
        mixed ^= mixed >> np.uint64(29)
    mixed *= MIX_B
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the universal hash functions."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def signature(found: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over the set, as 32 bits."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        part = np.multiply.outer(a, found[i : i + 2048])
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    n, count = signatures.shape
    parts = signatures.reshape(n, bands, count // bands).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * MIX_C, (n, bands)).copy()
    for j in range(parts.shape[2]):
        keys = (keys ^ parts[:, :, j]) * MIX_A
        keys ^= keys >> np.uint64(31)
    return (keys * MIX_B).view(np.int64)


def sign(docs: DataFrame, width: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, digest, sig, bands) of every row; digest, sig and bands null without words."""
    family = hash_family(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sizes, digests, sigs = [], [], np.zeros((part.num_rows, bands * rows), np.uint32)
                for i, text in enumerate(as_bytes(part.column(1))):
                    found = shingles(text, width)
                    sizes.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    if len(found):
                        sigs[i] = signature(found, family)
                keys = band_keys(sigs, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([s.tobytes() if n else None for s, n in zip(sigs, sizes)], pa.binary()),
                        pa.array([k if n else None for k, n in zip(keys, sizes)], pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "digest", "sig", "bands"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_col), run, "id long, n_shingles long, digest binary, sig binary, bands array<long>")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, in memory bounded by slices."""
    sizes = np.zeros((len(left), len(right)))
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])]) if len(values) else values
    shared = np.bincount(column.astype(np.int64))[column.astype(np.int64)] > 1 if len(values) else column
    column, owner = column[shared], owner[shared]
    for start in range(0, int(column.max(initial=-1)) + 1, SLICE):
        a, b = np.searchsorted(column, [start, start + SLICE])
        if a < b:
            held = np.zeros((len(left) + len(right), SLICE), np.float32)
            held[owner[a:b], column[a:b] - start] = 1
            sizes += held[: len(left)] @ held[len(left) :].T
    return sizes


def forest(ids: np.ndarray, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join two trees, as pairs of ids, larger first."""
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            kept.append((int(max(ids[a], ids[b])), int(min(ids[a], ids[b]))))
    return kept


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, one of left and one of right, whose sets share enough."""
    a, b = [sets[x] for x in left], [sets[x] for x in right]
    same = intersections(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - same
    x, y = np.nonzero((100 * same >= percent * union) & (left[:, None] != right[None, :]))
    return left[x], right[y]


EDGES = "u long, v long"


def _edges(rep: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Table:
    kept = forest(rep, list(zip(x.tolist(), y.tolist())))
    return pa.table({"u": pa.array([u for u, _ in kept], pa.int64()), "v": pa.array([v for _, v in kept], pa.int64())})


def weighed(members: DataFrame, classes: DataFrame, n_members: int, limit: int) -> DataFrame:
    """``members`` with ``bytes``: of the sets of the group where these pass ``BLOCK_BYTES``, else 0."""
    sized = joined(classes.select("rep", "n_shingles"), members, "rep", n_members, limit=limit)
    heavy = durable(sized.groupBy("group").agg((F.sum("n_shingles") * 8).alias("bytes")).where(F.col("bytes") > BLOCK_BYTES))
    n_heavy = heavy.count()
    if not n_heavy:
        return members.withColumn("bytes", F.lit(0).cast("long"))
    return durable(joined(members, heavy, "group", n_heavy, "left", limit).withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long"))).select(*members.columns, "bytes"))


def _chunked(members: DataFrame, block: int) -> DataFrame:
    """Adds the number of chunks of the group, by its classes and the bytes of their sets, and the one that the class is in."""
    chunks = members.withColumn("chunks", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    return chunks.withColumn("mine", F.pmod(F.xxhash64("rep", "group"), F.col("chunks")).cast("int"))


def linked_to_first(members: DataFrame, percent: int) -> DataFrame:
    """(u, v), u > v: spanning forests of the links in each chunk and of it to the first chunk.

    members: (rep, group, n, bytes, found). Classes of the first chunk go to every block of the group,
    the others to one.
    """
    cut = _chunked(members, BLOCK)
    blocks = cut.withColumn("block", F.explode(F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("mine"))))

    def run(keys, table):
        rep, side = table["rep"].to_numpy(), table["mine"].to_numpy()
        own = np.flatnonzero(side == keys[1].as_py())
        return _edges(rep, *_links([np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()], own, np.arange(len(rep)), percent)) if len(own) else _edges(rep, own, own)

    ship_package(members.sparkSession)
    return blocks.select("group", "block", "mine", "rep", "found").groupBy("group", "block").applyInArrow(run, EDGES)


def likely_across(members: DataFrame, least: float) -> DataFrame:
    """(group, i, j, rep): the classes of each block that may be linked to one of another component there.

    members: (rep, group, n, bytes, sig, comp). Signatures are compared, in blocks of two chunks, and
    a class is named if it agrees in the share ``least`` with a class of another component.
    """
    cut = _chunked(members, SIG_BLOCK).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = cut.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "comp", "sig")

    def run(keys, table):
        group, i, j = (k.as_py() for k in keys)
        rep, comp, side = (table[c].to_numpy() for c in ("rep", "comp", "mine"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(rep), -1)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        named = np.zeros(len(rep), bool)
        for some in (left[k : k + 32] for k in range(0, len(left), 32)):
            hit = ((sig[some, None, :] == sig[None, right, :]).mean(axis=2) >= least) & (comp[some][:, None] != comp[right][None, :])
            named[some] |= hit.any(axis=1)
            named[right] |= hit.any(axis=0)
        n = int(named.sum())
        return pa.table({"group": pa.array([group] * n, pa.int64()), "i": pa.array([i] * n, pa.int32()), "j": pa.array([j] * n, pa.int32()), "rep": pa.array(rep[named])})

    ship_package(members.sparkSession)
    return blocks.groupBy("group", "i", "j").applyInArrow(run, "group long, i int, j int, rep long")


def linked_across(named: DataFrame, percent: int) -> DataFrame:
    """(u, v): spanning forests of the links between components, by block.

    named: (group, i, j, rep, comp, found) of ``likely_across``. Classes of a block that are
    of one component are not compared.
    """

    def run(table):
        rep, comp = table["rep"].to_numpy(), table["comp"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()]
        order = np.argsort(comp, kind="stable")
        x, y = [], []
        for start in range(0, len(order), BLOCK):
            for other in range(start, len(order), BLOCK):
                left, right = order[start : start + BLOCK], order[other : other + BLOCK]
                if comp[left[0]] == comp[right[-1]]:  # in the order of components, all between are of one
                    continue
                a, b = _links(sets, left, right, percent)
                across = comp[a] != comp[b]
                x.append(a[across])
                y.append(b[across])
        none = [np.empty(0, np.int64)]
        return _edges(rep, np.concatenate(x or none), np.concatenate(y or none))

    ship_package(named.sparkSession)
    return named.groupBy("group", "i", "j").applyInArrow(run, EDGES)


def grouped(placed: DataFrame, limit: int) -> DataFrame:
    """(rep, group, n) of the classes that share a bucket with others, from (rep, key).

    The group is what buckets connect if n * n is at most the sum of the squares of its
    buckets' sizes, and otherwise the bucket.
    """
    buckets = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead"), F.expr("bit_xor(xxhash64(rep))").alias("mark")).where("c > 1")
    buckets = durable(buckets.groupBy("c", "mark", "lead").agg(F.min("key").alias("key")))
    n_buckets = buckets.count()
    members = durable(joined(placed, buckets, "key", n_buckets, limit=limit).select("rep", "key", "c", "lead"))
    stars, n_stars = components(members.select(F.col("rep").alias("u"), F.col("lead").alias("v")), limit)

    def with_star(rows: DataFrame, on: str) -> DataFrame:
        return joined(rows, stars.withColumnRenamed("node", on), on, n_stars, "left", limit).withColumn("star", F.coalesce("component", on)).drop("component")

    work = with_star(buckets, "lead").groupBy("star").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
    in_star = durable(with_star(members, "lead"))
    sizes = in_star.select("star", "rep").distinct().groupBy("star").agg(F.count(F.lit(1)).alias("n"))
    plan = durable(sizes.join(work, "star").select("star", F.when(F.col("n") * F.col("n") <= F.col("work"), F.col("n")).alias("n_star")))
    planned = joined(in_star, plan, "star", plan.count(), limit=limit)
    whole = planned.where("n_star is not null").select("rep", F.col("star").alias("group"), F.col("n_star").alias("n")).distinct()
    return whole.unionByName(planned.where("n_star is null").select("rep", F.col("key").alias("group"), F.col("c").alias("n")))


def with_sets(docs: DataFrame, members: DataFrame, count: int, width: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``members``, which have ``rep`` and ``count`` rows, with ``found``: the sorted shingle hashes of their text.

    docs: (id, text). Texts are never shuffled: few members are broadcast to them; of many a
    bitmap picks the texts, whose sets then meet their members by shuffle.
    """
    if count <= limit:
        rows = docs.join(F.broadcast(members.withColumnRenamed("rep", "id")), "id").select("text", "id", *(c for c in members.columns if c != "rep"))
    else:
        rows = maybe_in(docs, "id", members.select(F.col("rep").alias("id")), count).select("text", "id")
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            found = [shingles(t, width).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=[*names, "found"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:])
    made = map_arrow(rows, run, f"{schema}, found binary").withColumnRenamed("id", "rep")
    return made if count <= limit else durable(members).join(made, "rep")


def _edges_of(texts: DataFrame, classes: DataFrame, members: DataFrame, n_members: int, width: int, percent: int, least: float, limit: int) -> DataFrame:
    """Links that join all components of the members (rep, group, n): both rounds."""
    members = weighed(members, classes, n_members, limit)
    edges = durable(linked_to_first(with_sets(texts, members, n_members, width, limit), percent))
    large = members.where((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES))
    if not (n_large := large.count()):
        return edges
    found, n_found = components(edges, limit)
    placed = joined(large, found.withColumnRenamed("node", "rep"), "rep", n_found, "left", limit).select("rep", "group", "n", "bytes", F.coalesce("component", "rep").alias("comp"))
    placed = durable(placed)
    apart = durable(placed.groupBy("group").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("group"))
    left = durable(joined(placed, apart, "group", apart.count(), limit=limit))
    if not (n_left := left.count()):
        return edges
    signed = joined(classes.select("rep", "sig"), left, "rep", n_left, limit=limit).select("rep", "group", "n", "bytes", "sig", "comp")
    named = durable(likely_across(signed, least))
    if not (n_named := named.count()):
        return edges
    asked = durable(named.select("rep").distinct())
    sets = with_sets(texts, asked, asked.count(), width, limit)
    comps = left.select("rep", "comp").distinct()
    full = named.join(durable(joined(sets, comps, "rep", n_left, limit=limit)), "rep")
    return edges.unionByName(linked_across(full, percent))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """(id_col long, n_shingles, component_id, kept), one row per input row.

    Two documents are linked if percent/100 of the union of their shingle sets is shared;
    component_id is the smallest id that links reach, kept marks the document that has it.
    A pair at the threshold s shares a band with probability 1 - (1 - s^rows)^bands.

    Null and empty texts, and texts of white space, have no shingles and link with nothing.
    A null id is compared with nothing: its component is null and it is kept. Rows that repeat
    an id belong to one component, and all of them carry its mark. Ids must be whole numbers.
    Ties need no rule. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = durable(sign(docs, width, bands, rows, id_col, text_col))
    alike = signed.where("id is not null and digest is not null")
    classes = durable(alike.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))
    members = durable(grouped(classes.select("rep", F.explode("bands").alias("key")), limit))
    n_members = members.count()
    n_found = 0
    if n_members:
        share = percent / 100
        least = max(0.0, share - 4.5 * (share * (1 - share) / (bands * rows)) ** 0.5)
        found, n_found = components(_edges_of(texts, classes, members, n_members, width, percent, least, limit), limit)
    of_class = classes.select("digest", "rep")
    if n_found:
        of_class = joined(of_class, found.withColumnRenamed("node", "rep"), "rep", n_found, "left", limit)
        of_class = of_class.select("digest", F.coalesce("component", "rep").alias("component_id"))
    else:
        of_class = of_class.withColumnRenamed("rep", "component_id")
    whole = signed.select("id", "n_shingles", "digest").join(durable(of_class), "digest", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return whole.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
