"""Ranked lexical search: the best documents for each of a table of queries.

Documents are indexed in ranges: a row of the index holds up to ``RANGE_DOCS`` documents in the
order of their ids, and the postings of the queries' terms in them. A search makes of the
postings of each term a tree of greatest scores over ever longer ranges of documents, and adds
the trees of a query's terms: the sum at a range is a bound on the score of each document there.
The range with the highest bound is opened first, and ranges whose bound is below the score that
is last in the list so far stay closed, so most documents are never scored. Ranges whose bound
equals it are opened if they can hold a smaller id. The list goes on from row to row of a task;
the lists of the tasks are merged by rank.

Queries are taken in blocks of ``QUERY_BYTES`` of text, whose terms the tasks hold; documents
are never compared with queries one by one, nor postings shuffled.

Weights and scores are those of ``weight`` and ``impacts``, in whole numbers. A null text has no
terms. Every row is a document, repeated rows and ids too; a null id comes after the others
where scores are equal. Each row of the queries has a list of its own, an empty one if no
document holds its terms. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, scratch_folder
from .common import as_bytes, map_arrow

#: Bytes of query text whose terms are held at once.
QUERY_BYTES = 4_000_000
#: Documents of a row of the index, at most 2^16, and postings after which a row ends.
RANGE_DOCS, RANGE_POSTINGS = 4096, 1 << 19
#: Children of a range in the trees.
FANOUT = 16
#: Groups of lists that are merged apart before the last merge.
MERGE_GROUPS = 64

#: What is no ASCII letter or digit ends a term; A-Z are lowered, bytes beyond ASCII stay.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and bytes beyond ASCII, with A-Z lowered."""
    return text.translate(_FOLD).split()


def weight(docs: int, holding: int) -> int:
    """Of a term that ``holding`` of ``docs`` documents hold; ``docs`` counts those with any term."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """What a term adds to the score of a document, for each posting; all in 64-bit numbers, rounded down."""
    m = 100 - 75 + (75 * lengths * docs) // max(tokens, 1)
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


@dataclass
class Query:
    """Its key, its terms as numbers with how often each occurs, and the list of (-score, null id, id) so far."""

    key: object
    terms: np.ndarray
    times: np.ndarray
    best: list = field(default_factory=list)


def _index(vocabulary: dict[bytes, int], id_type: pa.DataType):
    """Rows (id, text) to rows of the index."""

    def row(ids: list, lengths: list[np.ndarray], postings: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        found, tfs = np.concatenate(postings), np.concatenate(counts)
        term, doc = found & 0xFFFFFFFF, place[found >> 32]
        sort = np.lexsort((doc, term))
        term, doc, tfs = term[sort], doc[sort], tfs[sort]
        terms, holding = np.unique(term, return_counts=True)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        raw = lambda values, kind: pa.array([values.astype(kind).tobytes()], pa.binary())
        n = np.concatenate(lengths)[order]
        return pa.record_batch({"ids": one([ids[i] for i in order], id_type), "lengths": raw(n, np.int64), "docs": pa.array([int((n > 0).sum())], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "terms": one(terms, pa.int64()), "holding": one(holding, pa.int64()), "places": raw(doc, np.uint16), "tfs": raw(tfs, np.uint32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, postings, counts, size = [], [], [], [], 0
        for batch in batches:
            split = [terms_of(t) for t in as_bytes(batch["text"])]
            n = np.array([len(t) for t in split], np.int64)
            numbers = np.fromiter((vocabulary.get(t, -1) for doc in split for t in doc), np.int64, int(n.sum()))
            pairs = np.repeat(np.arange(len(ids), len(ids) + len(n)) << 32, n) | numbers
            found, count = np.unique(pairs[numbers >= 0], return_counts=True)
            ids += batch["id"].to_pylist()
            lengths.append(n), postings.append(found), counts.append(count)
            size += len(found)
            if len(ids) > RANGE_DOCS - len(n) or size >= RANGE_POSTINGS:
                yield row(ids, lengths, postings, counts)
                ids, lengths, postings, counts, size = [], [], [], [], 0
        if ids:
            yield row(ids, lengths, postings, counts)

    return run


class MaxTrees:
    """The trees of one row of the index.

    On each level a term has, for the ranges in which it occurs, the greatest impact there; keys
    number term and range together, so the children of a range are a slice for each term. There
    must be a posting.
    """

    def __init__(self, ids: list, terms: np.ndarray, holding: np.ndarray, places: np.ndarray, values: np.ndarray, fanout: int = FANOUT):
        self.ids, self.terms, self.fanout = ids, terms, fanout
        self.levels, self.widths = [], []
        key, width = np.repeat(np.arange(len(terms)), holding), len(ids)
        place = places.astype(np.int64)
        while True:
            full = key * width + place
            first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
            values = np.maximum.reduceat(values, first)
            self.levels.append((full[first], values))
            self.widths.append(width)
            if width == 1:
                break
            key, place, width = key[first], place[first] // fanout, -(-width // fanout)

    def bounds(self, level: int, parent: int, terms: np.ndarray, times: np.ndarray) -> tuple[int, np.ndarray]:
        """The first child of range ``parent`` of the level above, and the summed bounds of its children."""
        keys, values = self.levels[level]
        width = self.widths[level]
        lo, hi = (0, 1) if parent < 0 else (parent * self.fanout, min(width, (parent + 1) * self.fanout))
        begin = np.searchsorted(keys, terms * width + lo)
        sizes = np.searchsorted(keys, terms * width + hi) - begin
        at = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, keys[at] - np.repeat(terms * width + lo, sizes), values[at] * np.repeat(times, sizes))
        return lo, out

    def search(self, query: Query, k: int) -> None:
        """Put documents of this row that are among the ``k`` best so far into the query's list."""
        held = np.searchsorted(self.terms, query.terms)
        held[held == len(self.terms)] = 0
        there = self.terms[held] == query.terms
        terms, times, best = held[there], query.times[there], query.best
        if not len(terms):
            return
        top = len(self.levels) - 1
        heap = [(-int(self.bounds(top, -1, terms, times)[1][0]), 0, top, 0)]

        def entry(negative: int, doc: int) -> tuple:
            found = self.ids[doc]
            return negative, found is None, 0 if found is None else found

        def hopeless(negative: int, doc: int) -> bool:
            """Whether no document from this one on with that bound can enter the list."""
            return negative == 0 or len(best) == k and entry(negative, doc) >= best[-1]

        while heap:
            negative, doc, level, at = heapq.heappop(heap)
            if negative == 0 or len(best) == k and negative > best[-1][0]:
                return
            if hopeless(negative, doc):
                continue
            if level == 0:
                insort(best, entry(negative, doc))
                del best[k:]
                continue
            first, bounds = self.bounds(level - 1, at, terms, times)
            span = self.fanout ** (level - 1)
            for i, bound in enumerate(bounds.tolist(), first):
                if not hopeless(-bound, i * span):
                    heapq.heappush(heap, (-bound, i * span, level - 1, i))


def _search(queries: list[Query], weights: np.ndarray, docs: int, tokens: int, k: int, key_type: pa.DataType, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Query(q.key, q.terms, q.times) for q in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                values = lambda name: row[name].values.to_numpy(zero_copy_only=False)[row[name].offsets[0].as_py() : row[name].offsets[1].as_py()]  # noqa: B023, E731
                raw = lambda name, kind: np.frombuffer(row[name][0].as_py(), kind)  # noqa: B023, E731
                terms, holding, places = values("terms"), values("holding"), raw("places", np.uint16)
                if not len(terms):
                    continue
                value = impacts(np.repeat(weights[terms], holding), raw("tfs", np.uint32).astype(np.int64), raw("lengths", np.int64)[places], docs, tokens)
                trees = MaxTrees(row["ids"][0].as_py(), terms, holding, places, value)
                for query in asked:
                    trees.search(query, k)
        rows = [(number, q.key, None if null else found, -negative) for number, q in enumerate(asked) for negative, null, found in q.best]
        columns = zip(*rows) if rows else ((),) * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), key_type, id_type, pa.int64()))], ["number", "item", "id", "score"])

    return run


def _block(docs: DataFrame, rows: list, k: int, types: tuple[str, str]) -> DataFrame:
    """(number, item, id, score): the best documents for one block of queries, written to the checkpoint folder."""
    spark = docs.sparkSession
    key_type, id_type = (pa.int64() if t in ("bigint", "int", "smallint", "tinyint") else pa.string() for t in types)
    counted = [(r["item"], Counter(terms_of((r["text"] or "").encode()))) for r in rows]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
    queries = []
    for key, c in counted:
        numbers = sorted((vocabulary[t], n) for t, n in c.items())
        queries.append(Query(key, np.array([t for t, _ in numbers], np.int64), np.array([n for _, n in numbers], np.int64)))
    with scratch_folder(spark, "ranges") as folder:
        map_arrow(docs, _index(vocabulary, id_type), f"ids array<{_wide(types[1])}>, lengths binary, docs long, tokens long, terms array<long>, holding array<long>, places binary, tfs binary").write.parquet(folder)
        index = spark.read.parquet(folder)
        # at most a row for each term of the block
        held = index.select(F.explode(F.arrays_zip("terms", "holding")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.holding").alias("n")).toArrow()
        number, tokens = (int(x or 0) for x in index.agg(F.sum("docs"), F.sum("tokens")).first())
        weights = np.zeros(len(vocabulary), np.int64)
        for term, n in zip(held["term"].to_pylist(), held["n"].to_pylist()):
            weights[term] = weight(number, n)
        found = map_arrow(index.drop("docs", "tokens"), _search(queries, weights, number, tokens, k, key_type, id_type), f"number long, item {_wide(types[0])}, id {_wide(types[1])}, score long")
        order = (F.desc("score"), F.asc_nulls_last("id"))
        group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))
        near = found.withColumn("part", group).withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("rank") <= k)
        last = near.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
        return durable(last.select("item", "rank", "id", "score"))


def _wide(kind: str) -> str:
    return "long" if kind in ("bigint", "int", "smallint", "tinyint") else "string"


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item, rank, id, score) under the names of the given columns: the ``k`` best documents of each query.

    Ids and items are whole numbers (as longs) or else strings. Only documents with a score
    above 0 are listed; equal scores go by id.
    """
    wide = lambda df, c: F.col(c).cast(_wide(dict(df.dtypes)[c]))
    asked = queries.select(wide(queries, item_col).alias("item"), F.col(query_col).alias("text"))
    texts = docs.select(wide(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    types = dict(queries.dtypes)[item_col], dict(docs.dtypes)[id_col]
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    number = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = [_block(texts, asked.where(number == b).collect(), k, types) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found).select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
