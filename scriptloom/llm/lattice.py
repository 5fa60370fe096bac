"""Embedding near-duplicates by lattice hashing.

Each of several tables projects a unit vector at random to eight dimensions and decodes it to
the nearest point of the E8 lattice, its home cell. A vector also visits the cells whose
lattice points are its next nearest. Two vectors meet where one is at home and the other is at
home or visits. All meetings in a cell are verified by cosine in double precision, as matrix
products over blocks of bounded size, and a block returns for each vector the number of its
links and a spanning forest of them, never pairs.

The lattice is scaled so that vectors at the threshold are ``REACH`` lattice units apart,
whatever the threshold, so the recall at the threshold is the same for all: at least 0.997 as
measured for 8 to 1024 dimensions and thresholds from 0.3 to 0.99. Closer pairs are missed less.

A visit leads to a meeting only where some vector is at home. A bitmap of the cells that are
anyone's home, sized by their counted number, tells most visits that there is nobody, and these
are never shuffled. Wrong answers of the bitmap cost rows, never links.

A pair may meet in many cells. It is counted in the first: the lowest table, and within that
the lower of the two home cells; blocks see the cells of both sides and decide alike.

Equal vectors of a label are one class with a multiplicity, found by a digest, so copies are
never compared and vectors are no keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import MIX_A, MIX_B, MIX_C, map_arrow, non_empty, ship_package
from .components import BROADCAST_ROWS, components, joined

#: A cell of more classes is cut into chunks of about this many, of which two are a block.
BLOCK = 1024
#: Smaller cells are compared by the thousand of rows in one task.
SMALL = 256
BATCH_ROWS = 4096
TABLES = 8
VISITS = 12
#: Lattice units between two unit vectors at the threshold.
REACH = 1.01
#: Bits of the map of homes for each of them, and its most and least bits.
HOME_BITS, MOST_BITS, LEAST_BITS = 16, 1 << 30, 1 << 20
#: Pairs that are handled at once.
PAIRS = 8192
SEED = 11


def scale_for(threshold: float) -> float:
    """Lattice units for a distance of one between unit vectors."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    return REACH / math.sqrt(max(2 - 2 * threshold, 1e-8))


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1.0 if bits >> k & 1 else -1.0 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors with an even sum."""
    near = np.rint(x)
    odd = near.sum(axis=1) % 2 != 0
    gap = x - near
    worst = np.abs(gap).argmax(axis=1)
    step = np.where(gap[np.arange(len(x)), worst] >= 0, 1.0, -1.0)
    near[odd, worst[odd]] += step[odd]
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the even integer vectors and the same shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _cell_hash(points: np.ndarray, table: int, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points (last axis 8) of a table; salt: by vector."""
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = salt ^ np.uint64(int(MIX_C) * (table + 1) % (1 << 64))
    for k in range(8):
        key = (key ^ whole[..., k]) * MIX_A
        key ^= key >> np.uint64(31)
    return key * MIX_B


def projections(dims: int, tables: int) -> np.ndarray:
    """tables x dims x 8, rows of orthonormal columns scaled so that lengths keep on average."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(tables):
        q = np.linalg.qr(rng.normal(size=(max(dims, 8), 8)))[0][:dims]
        out.append(q * math.sqrt(dims / 8))
    return np.array(out)


def cells(unit: np.ndarray, salt: np.ndarray, tables: int, visits: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(n x tables home keys, n x tables x visits visited keys) of unit vectors."""
    home = np.empty((len(unit), tables), np.uint64)
    seen = np.empty((len(unit), tables, visits), np.uint64)
    for t, matrix in enumerate(projections(unit.shape[1], tables)):
        x = unit @ matrix * scale
        at = nearest_e8(x)
        home[:, t] = _cell_hash(at, t, salt)
        if visits:
            near = np.argpartition(-((x - at) @ ROOTS.T), visits - 1, axis=1)[:, :visits]
            seen[:, t] = _cell_hash(at[:, None, :] + ROOTS[near], t, salt[:, None])
    return home, seen


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _salt(labels: np.ndarray, dims: int) -> np.ndarray:
    """By label and length, so that only vectors that may be linked can meet."""
    return (labels.astype(np.int64).view(np.uint64) + np.uint64(1)) * MIX_B + np.uint64(dims)


def _met_before(tab, home_a, seen_a, home_b, seen_b) -> np.ndarray:
    """Whether pairs (rows of a with rows of b) meet in a table below ``tab`` (one for all, or by pair)."""
    met = np.zeros(len(home_a), bool)
    for k in range(int(np.max(tab, initial=0))):
        here = home_a[:, k] == home_b[:, k]
        here |= (seen_a[:, k] == home_b[:, k, None]).any(axis=1) | (seen_b[:, k] == home_a[:, k, None]).any(axis=1)
        met |= here & (k < tab)
    return met


def _close_in_cells(cell: np.ndarray, at_home: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell, one at home, that are close enough."""
    order = np.argsort(cell, kind="stable")
    sorted_cells = cell[order]
    found = []
    for step in range(1, len(cell)):
        same = np.flatnonzero(sorted_cells[step:] == sorted_cells[:-step])
        if not len(same):
            break
        x, y = order[same], order[same + step]
        some = at_home[x] | at_home[y]
        x, y = x[some], y[some]
        close = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        found.append((x[close], y[close]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _close_in_block(left: np.ndarray, right: np.ndarray, alone: bool, at_home: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for two chunks of a large cell, or for one chunk with itself."""
    found = []
    for part in (left[k : k + 256] for k in range(0, len(left), 256)):
        close = unit[part] @ unit[right].T >= threshold
        close &= at_home[part][:, None] | at_home[right][None, :]
        if alone:
            close &= part[:, None] < right[None, :]
        x, y = np.nonzero(close)
        found.append((part[x], right[y]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class Trees:
    """A spanning forest of links that come in parts; rows of a tree have the same label."""

    def __init__(self, count: int):
        self.label = np.arange(count)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = np.flatnonzero(self.label[a] != self.label[b])
        if not len(new):
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        before = len(self.links)
        for p, q in zip(a[new].tolist(), b[new].tolist()):
            x, y = top(int(self.label[p])), top(int(self.label[q]))
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((p, q))
        if len(self.links) > before:
            old, place = np.unique(self.label, return_inverse=True)
            self.label = np.array([top(int(x)) for x in old])[place]


def link_blocks(members: DataFrame, count: int, threshold: float, tables: int, visits: int, scale: float) -> DataFrame:
    """(rep, n_links, v): per block the links that each class has there, and forest edges.

    members: ``count`` rows of (cell, tab, n, home, rep, mult, label, vector). Rows with v null
    count links; rows with v are edges (rep, v) of the block's spanning forest.
    """
    batches = max(64, count // BATCH_ROWS)
    small = F.col("n") <= SMALL
    mine = F.pmod(F.xxhash64("rep", "cell"), F.col("chunks")).cast("int")
    cut = members.withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    batch = F.when(small, F.pmod(F.xxhash64("cell"), F.lit(batches))).otherwise(F.col("cell"))
    i, j = (F.when(small, F.lit(-1)).otherwise(f("mine", "other")) for f in (F.least, F.greatest))
    blocks = cut.select(batch.alias("batch"), i.alias("i"), j.alias("j"), "cell", "tab", "mine", "home", "rep", "mult", "label", "vector")

    def run(keys, table):
        _, i, j = (k.as_py() for k in keys)
        cell, tab, rep, mult, side, at_home, label = (table[c].to_numpy() for c in ("cell", "tab", "rep", "mult", "mine", "home", "label"))
        vectors = [np.frombuffer(v, np.float64) for v in table["vector"].to_pylist()]
        sizes = np.array([len(v) for v in vectors])
        links, trees = np.zeros(len(rep), np.int64), Trees(len(rep))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            unit = _unit(np.stack([vectors[r] for r in rows]))
            if i < 0:
                x, y = _close_in_cells(cell[rows], at_home[rows], unit, threshold)
            else:
                x, y = _close_in_block(np.flatnonzero(side[rows] == i), np.flatnonzero(side[rows] == j), i == j, at_home[rows], unit, threshold)
            if not len(x):
                continue
            used, places = np.unique(np.concatenate([x, y]), return_inverse=True)
            homes, seen = cells(unit[used], _salt(label[rows[used]], int(size)), tables, visits, scale)
            p_all, q_all = places[: len(x)], places[len(x) :]
            for part in range(0, len(x), PAIRS):
                p, q, r = p_all[part : part + PAIRS], q_all[part : part + PAIRS], rows[x[part : part + PAIRS]]
                t, w = tab[r], rows[y[part : part + PAIRS]]
                first = ~_met_before(t, homes[p], seen[p], homes[q], seen[q])
                # where each visits the home of the other, the pair counts in the lower home
                home_p, home_q = homes[p, t], homes[q, t]
                mutual = (home_p != home_q) & (seen[p, t] == home_q[:, None]).any(axis=1) & (seen[q, t] == home_p[:, None]).any(axis=1)
                first &= ~mutual | (np.minimum(home_p.view(np.int64), home_q.view(np.int64)) == cell[r])
                r, w = r[first], w[first]
                np.add.at(links, r, mult[w])
                np.add.at(links, w, mult[r])
                trees.add(r, w)
        tree = [(int(max(rep[a], rep[b])), int(min(rep[a], rep[b]))) for a, b in trees.links]
        some = np.flatnonzero(links)
        return pa.table(
            {
                "rep": pa.array([*rep[some].tolist(), *(u for u, _ in tree)], pa.int64()),
                "n_links": pa.array([*links[some].tolist(), *[0] * len(tree)], pa.int64()),
                "v": pa.array([*[None] * len(some), *(v for _, v in tree)], pa.int64()),
            }
        )

    ship_package(members.sparkSession)
    return blocks.groupBy("batch", "i", "j").applyInArrow(run, "rep long, n_links long, v long")


def _signed(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, digest, vector as doubles in bytes); digest and vector null where nothing can be linked."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.select("id", "label", F.when(usable, F.col("vector")).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            # adding zero makes the two zeros one
            raw = [None if v is None else (np.asarray(v, np.float64) + 0.0).tobytes() for v in batch.column(2).to_pylist()]
            digests = [None if x is None else xxhash.xxh3_128_digest(x + label.to_bytes(8, "little", signed=True)) for x, label in zip(raw, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["id", "label", "digest", "vector"])

    return map_arrow(rows, run, "id long, label long, digest binary, vector binary")


def _cells_of(batches: Iterator[pa.RecordBatch], tables: int, visits: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(reps, cells) of batches of (rep, label, vector); cells: rows x tables x (home, visits)."""
    for batch in non_empty(batches):
        vectors = [np.frombuffer(v, np.float64) for v in batch.column(2).to_pylist()]
        sizes = np.array([len(v) for v in vectors])
        rep, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            home, seen = cells(_unit(np.stack([vectors[i] for i in some])), _salt(label[some], int(size)), tables, visits, scale)
            yield rep[some], np.concatenate([home[:, :, None], seen], axis=2).view(np.int64)


def _homes(classes: DataFrame, count: int, tables: int, scale: float, most_bits: int) -> tuple[int, object]:
    """(bits, broadcast bitmap) of the places of all homes of ``count`` classes."""
    bits = min(most_bits, max(LEAST_BITS, 1 << (HOME_BITS * tables * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, every in _cells_of(batches, tables, 0, scale):
            yield pa.RecordBatch.from_arrays([pa.array(every.ravel())], names=["cell"])

    place = F.pmod(F.col("cell"), F.lit(bits))
    parts = map_arrow(classes.select("rep", "label", "vector"), run, "cell long").select(place.alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits, classes.sparkSession.sparkContext.broadcast(out)


def placed(classes: DataFrame, count: int, tables: int, visits: int, scale: float, most_bits: int = MOST_BITS) -> DataFrame:
    """(cell, tab, home, rep): each class at home, and where it visits a cell that may be a home."""
    bits, homes = _homes(classes, count, tables, scale, most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, every in _cells_of(batches, tables, visits, scale):
            at = every & (bits - 1)  # pmod by a power of two
            known = homes.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            known[:, :, 0] = True
            row, table, kind = np.nonzero(known)
            yield pa.RecordBatch.from_arrays([pa.array(every[known]), pa.array(table.astype(np.int32)), pa.array(kind == 0), pa.array(rep[row])], names=["cell", "tab", "home", "rep"])

    return map_arrow(classes.select("rep", "label", "vector"), run, "cell long, tab int, home boolean, rep long")


def near_vectors(
    df: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tables: int = TABLES,
    visits: int = VISITS,
    limit: int = BROADCAST_ROWS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(id_col long, n_links, component_id, kept), one row per input row.

    Vectors of one label and one length are linked if their cosine is at least the threshold.
    n_links counts the other vectors linked directly, component_id is the smallest id that
    links reach, kept marks the vector that has it. No link below the threshold is reported;
    a pair at the threshold is found with the recall that the tables and visits give.

    Vectors that are null, zero, empty or hold null or non-finite components, and vectors with
    a null label or id, link with nothing (a null id has a null component and is kept). Equal
    vectors of a label are linked; repeated rows count as further vectors with the same id. An
    empty table gives no rows; other columns are ignored. Thresholds outside (0, 1] are errors.

    The bitmap of homes has at most ``most_bits`` bits. Tables of so many vectors that it fills
    up shuffle more visits, with the same result.
    """
    scale = scale_for(threshold)
    signed = durable(_signed(df, id_col, vector_col, label_col))
    found = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = durable(found)
    count = classes.count()
    cells_of = durable(placed(classes, count, tables, visits, scale, most_bits))
    met = durable(cells_of.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("at_home")).where("n > 1 and at_home > 0").select("cell", "n"))
    members = durable(joined(cells_of, met, "cell", met.count(), limit=limit))
    full = members.join(classes.select("rep", "mult", "label", "vector"), "rep")
    got = durable(link_blocks(full, members.count(), threshold, tables, visits, scale))
    counts = got.where("v is null").groupBy("rep").agg(F.sum("n_links").alias("links"))
    found, n_found = components(got.where("v is not null").select(F.col("rep").alias("u"), "v"), limit)
    of_class = joined(classes.select("digest", "rep", "mult").join(counts, "rep", "left"), found.withColumnRenamed("node", "rep"), "rep", n_found, "left", limit)
    of_class = durable(of_class.select("digest", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    whole = signed.select("id", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
