"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text are turned into text statistics: character classes,
repetition of words, sentences and lines, word shapes. The share of good text among the
unlabelled, the class prior, is estimated by best-bin estimation: the smallest ratio, over
thresholds of a plain positive-against-unlabelled score on rows kept apart, of the unlabelled
to the positive rows above the threshold. A model of one hidden layer then minimises
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss, stepping back from the second term where it is negative.

Texts become statistics once; all that follows reads the table of these. At most ``max_positive``
positives, chosen by the hash of their id, go to every task. The unlabelled are not sampled: they
are dealt into shards of about ``SHARD_ROWS``, every shard takes the same layers over all its rows
by gradient steps, and the layers of the shards are averaged by their rows; ``ROUNDS`` times.
Standard scores and the class prior are statistics of the corpus: sums over all texts of the fold,
and a histogram of the plain score of each. Sums are of whole numbers, so they do not depend on
the order in which tasks end. Everything is scored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import as_bytes, first_by_hash, map_arrow, non_empty

#: Bound of the labelled documents on which the model is fitted.
MAX_POSITIVE = 8_000
#: Unlabelled rows of a shard, and the most shards; beyond that shards grow, and their steps with them.
SHARD_ROWS, MOST_SHARDS = 16_384, 20_000
#: Rounds of averaging for the plain score and for the model; least steps of a shard in a round; rows of a step.
PLAIN_ROUNDS, ROUNDS, STEPS, BATCH = 2, 6, 200, 256
#: Parts of one in which sums over shards are counted.
FINE = float(1 << 30)
PUNCTUATION = np.frombuffer(string.punctuation.encode(), np.uint8)
N_FEATURES = len(PUNCTUATION) + 17


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(text: bytes) -> np.ndarray:
    """Statistics of a text; an empty text has its own first feature and zeros."""
    out = np.zeros(N_FEATURES)
    words = text.split()
    n = len(words)
    if not n:
        out[0] = 1
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = len(text)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    sentences = [s for s in text.replace(b"\n", b". ").split(b". ") if s]
    lines = [s for s in text.split(b"\n") if s]
    distinct = len(set(words))
    shares = counts[counts > 0] / total
    out[1] = _share(upper, upper + lower)
    out[2] = _share(counts[48:58].sum(), total)
    out[3] = _share(counts[128:].sum(), total)
    out[4] = _share(counts[9:14].sum() + counts[32], total)
    out[5] = np.log1p(n) / 10
    out[6] = np.log(distinct / n)
    out[7] = np.log(distinct) / np.log(n + 1)
    out[8] = sum(map(eq, words, words[1:])) / n
    out[9] = _share(len(set(sentences)), len(sentences))
    out[10] = _share(len(set(lines)), len(lines))
    out[11] = np.log(len(set(zip(words, words[1:]))) / n + 1e-3) if n > 1 else 0
    out[12] = np.log(total / n)
    out[13] = np.log(n / max(1, len(sentences)))
    out[14] = np.log(n / max(1, len(lines)))
    out[15] = sum(map(bytes.isupper, words)) / n
    out[16] = -(shares * np.log(shares)).sum()
    out[17:] = np.sqrt(counts[PUNCTUATION] / n)
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    prior: float

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return forward(self.layers, np.clip((x - self.mean) / self.scale, -6, 6))[1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.outputs(x), -60, 60)))


def forward(layers, x):
    w, b, v, c = layers
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c[0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _gradient(layers, x, dz, decay):
    """Of sum(dz * output) by the parameters, with weight decay."""
    w, b, v, c = layers
    hidden = forward(layers, x)[0]
    dh = np.outer(dz, v) * (1 - hidden**2)
    return [x.T @ dh + decay * w, dh.sum(axis=0), hidden.T @ dz + decay * v, np.array([dz.sum()])]


def risk_slopes(zp: np.ndarray, zu: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the risk by the outputs for positive and for unlabelled rows; no prior: p against u.

    The losses are ln(1 + e^-z) for the positive class and ln(1 + e^z) for the negative one.
    Where the estimated negative risk is below zero, the step goes up that risk alone.
    """
    if prior is None:
        return (_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)
    if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
        return prior * ((_sigmoid(zp) - 1) - _sigmoid(zp)) / len(zp), _sigmoid(zu) / len(zu)
    return prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)


def first_layers(n: int, width: int = 24, seed: int = 5) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 1 / np.sqrt(n), (n, width)), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width), np.zeros(1)]


def descend(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None, begun: float, ended: float, seed: int, rate: float = 4e-3, decay: float = 1e-4) -> list[np.ndarray]:
    """Layers after steps that lower the non-negative risk; without a prior, of plain p against u.

    Steps go through u in turn, in a shuffled order, ``STEPS`` at least and every row once at
    least. begun, ended: the part of the whole descent that this is, by which the pace falls.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(u))
    steps = max(STEPS, -(-len(u) // BATCH))
    first, second = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    for step in range(1, steps + 1):
        taken = np.arange((step - 1) * BATCH, step * BATCH) % len(u)
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[order[taken]]
        zp, zu = forward(layers, xp)[1], forward(layers, xu)[1]
        dp, du = risk_slopes(zp, zu, prior)
        slopes = [a + b for a, b in zip(_gradient(layers, xp, dp, decay), _gradient(layers, xu, du, decay))]
        pace = rate * min(1.0, 3 * (1 - begun - (ended - begun) * (step - 1) / steps))
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


#: Thresholds at which the scores of the unlabelled are counted.
GRID = 200


def prior_grid(p: np.ndarray) -> np.ndarray:
    """Thresholds for best-bin estimation, from the scores of positives."""
    return np.quantile(p, np.linspace(0, 1, GRID))


def binned(scores: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """How many scores reach as many of the thresholds as the place says, from none to all."""
    return np.bincount(np.searchsorted(grid, scores, side="right"), minlength=len(grid) + 1)


def estimate_prior(p: np.ndarray, bins: np.ndarray, grid: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Best-bin estimate of the share of positives among the unlabelled.

    p: scores of positives that the score was not fitted on; bins: the unlabelled, see ``binned``.
    """
    n = bins.sum()
    above_p = np.array([(p >= c).mean() for c in grid])
    above_u = np.cumsum(bins[::-1])[::-1][1:] / n
    slack = np.sqrt(np.log(4 / delta) / 2 / n) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    ok = above_p >= gamma
    bound = (above_u[ok] + (1 + gamma) * slack) / above_p[ok]
    at = np.flatnonzero(ok)[bound.argmin()]
    return float(np.clip(above_u[at] / above_p[at], 0.05, 0.95))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x) of every row, x the statistics of its text; written to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            x = np.stack([features(t) for t in as_bytes(batch.column(1))]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "x"])

    return durable(map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, x array<float>"))


def _summed(parts: DataFrame) -> dict[int, int]:
    """(place, value) as exact whole sums; there are as many places as a model has numbers."""
    return {r["place"]: int(r["value"]) for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}


def _places(values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"place": pa.array(np.arange(len(values)), pa.int64()), "value": pa.array([str(int(v)) for v in values])})


def moments(shards: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (2 * N_FEATURES + 1)
        for batch in non_empty(batches):
            x = np.round(_vectors(batch["x"]) * 65536)
            for i, v in enumerate([*x.sum(axis=0), *(x * x).sum(axis=0), len(x)]):
                sums[i] += int(v)
        yield _places(np.array(sums, object))

    got = _summed(map_arrow(shards.select("x"), run, "place long, value string"))
    n = max(got.get(2 * N_FEATURES, 0), 1)
    mean = np.array([got.get(i, 0) for i in range(N_FEATURES)]) / n / 65536
    square = np.array([got.get(N_FEATURES + i, 0) for i in range(N_FEATURES)], float) / n / 65536**2
    return mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6


def minimise(p: np.ndarray, shards: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float | None, rounds: int) -> tuple[np.ndarray, ...]:
    """Layers that minimise the risk over the positives ``p``, in standard scores, and all rows of the shards."""
    layers = first_layers(p.shape[1])
    shapes = [a.shape for a in layers]
    cuts = np.cumsum([a.size for a in layers])
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], begin=layers, turn=turn) -> Iterator[pa.RecordBatch]:
            held = [_vectors(b["x"]).astype(np.float32) for b in non_empty(batches)]
            if held:
                u = np.clip((np.concatenate(held) - mean) / scale, -6, 6)
                mine = descend([a.copy() for a in begin], p, u, prior, turn / rounds, (turn + 1) / rounds, turn)
                flat = np.concatenate([a.ravel() for a in mine])
                yield _places(np.array([*(int(v) * len(u) for v in np.round(flat * FINE)), len(u)], object))

        got = _summed(map_arrow(shards.select("x"), run, "place long, value string"))
        n = got[int(cuts[-1])]
        flat = np.array([got[i] / n for i in range(cuts[-1])]) / FINE
        layers = [part.reshape(shape) for part, shape in zip(np.split(flat, cuts[:-1]), shapes)]
    return tuple(layers)


def count_bins(shards: DataFrame, model: QualityModel, grid: np.ndarray) -> np.ndarray:
    """``binned`` for the outputs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(grid) + 1, np.int64)
        for batch in non_empty(batches):
            seen += binned(model.outputs(_vectors(batch["x"])), grid)
        yield _places(seen)

    got = _summed(map_arrow(shards.select("x"), run, "place long, value string"))
    return np.array([got.get(i, 0) for i in range(len(grid) + 1)], float)


def train(table: DataFrame, labels: DataFrame, fold, label_col: str = "quality", max_positive: int = MAX_POSITIVE, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id") -> QualityModel:
    """Fit on positives of the labels and unlabelled texts, both within ``fold(id column)``.

    table: ``featurise`` of the documents. The chosen ids (a bounded number) are broadcast. An id
    that is labelled both ways is no positive; null ids and labels teach nothing, and of a
    positive id that repeats one text does. Every row with an id is unlabelled text, as often as
    it comes. Without positives or unlabelled rows every text scores one half.
    """
    once = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"))
    good = once.where((F.col("y") == 1) & fold(F.col("_id"))).select("_id")
    chosen = first_by_hash(good, good.count(), max_positive).select("_id")
    every = table.select(F.col(id_col).alias("_id"), "x").where(F.col("_id").isNotNull() & fold(F.col("_id")))
    some = table.select(F.col(id_col).alias("_id"), "x").join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("x").alias("x")).toArrow()
    positive = np.array(some["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    positive = positive[np.lexsort(positive.T[::-1])]  # the same fit, whatever order the rows come in
    n = every.count()
    if not len(positive) or not n:
        zero = (np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.zeros(1))
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), zero, 0.5)
    count = min(MOST_SHARDS, -(-n // shard_rows))
    # dealt in turn, so that rows of one id lie apart, and in an order of their own in a shard
    dealt = every.withColumn("_at", F.monotonically_increasing_id()).repartition(count)
    shards = durable(dealt.sortWithinPartitions("_id", "_at").select("x"))
    mean, scale = moments(shards)
    p = np.clip((positive[np.random.default_rng(3).permutation(len(positive))] - mean) / scale, -6, 6)
    seen, apart = (p[::2], p[1::2]) if len(p) > 1 else (p, p)
    plain = QualityModel(mean, scale, minimise(seen, shards, mean, scale, None, PLAIN_ROUNDS), 0.5)
    scores = forward(plain.layers, apart)[1]
    grid = prior_grid(scores)
    prior = estimate_prior(scores, count_bins(shards, plain, grid), grid)
    return QualityModel(mean, scale, minimise(p, shards, mean, scale, prior, ROUNDS), prior)


def score_quality(table: DataFrame, model: QualityModel, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(id_col, score, predicted), one row per row of ``featurise``, without a shuffle.

    Null and empty texts are scored from their own feature. Null ids stay null, repeated rows
    are repeated, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            p = model.probabilities(_vectors(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return map_arrow(table.select(id_col, "x"), run, f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            p = model.probabilities(np.stack([features(t) for t in as_bytes(batch.column(at))]).astype(np.float32).astype(float))
            yield batch.filter(pa.array(p >= threshold))

    return map_arrow(docs, run, docs.schema)
