"""Toxic passages as maximum-scoring segments of token log-odds.

Token log-odds of toxic against clean text come from labelled documents under an informative
Dirichlet prior: the background frequency of the token times a prior mass. Besides the word
itself its prefixes are tokens, so that rare words of a toxic stem count. A word scores by the
highest lower end of the log-odds intervals of its tokens where that is above a half, and by a
drift below zero otherwise, so a random text has a negative expected score. One linear scan finds all maximal
scoring segments of a text. Scores of clean training texts give the two parameters of the
extreme-value law of the best segment of a text of a given length; the segments that are
significant under it are a document's toxic passages, and the tail probabilities, through a
logistic calibration on the training fold, its score.

The model is fitted on at most ``max_rows`` labelled documents of each class, chosen by the
hash of their id. That bounds the ids that are broadcast to select them; the token counts of
these documents are then summed in a shuffle and the tokens with evidence go to the driver.
The calibration weighs each class by its labelled documents over its chosen ones, so its base
rate is that of all labels, whatever the bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, first_by_hash, map_arrow, non_empty

LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bound of the labelled documents of each class on which the model is fitted.
MAX_ROWS = 12_000
#: Documents with the token that it takes for a weight of its own, in the toxic class, however many are labelled.
MIN_DOCS = 3
DRIFT = -0.05


#: Lengths, in bytes, of the prefixes of a word that are tokens too.
PREFIXES = (4, 5, 6, 7, 8, 10)
#: Words whose scores a worker remembers before it starts anew.
REMEMBERED = 150_000


def letter_words(text: bytes) -> list[bytes]:
    """Lower-case runs of letters; digits and punctuation separate words."""
    return text.lower().translate(LETTERS).split()


def tokens_of(word: bytes) -> list[bytes]:
    """The word and its proper prefixes, these marked by a caret."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    The candidates are kept with the sums to their left and right ends and a link to the
    nearest earlier one that begins lower. A new one is joined to that, if it ends higher;
    none can then be extended or overlap.
    """
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, low, high = i, total, total + s
        total = high
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, i + 1, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def runs(scores: np.ndarray) -> tuple[list[int], list[float]]:
    """Places and summed scores: each positive token, and each stretch between two as one."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return [], []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    between = sums[at[1:]] - sums[at[:-1] + 1]
    places, values = [int(at[0])], [float(scores[at[0]])]
    for i, gap in zip(at[1:].tolist(), between.tolist()):
        places += [-1, i]
        values += [gap, float(scores[i])]
    return places, values


@dataclass(frozen=True)
class ToxicModel:
    """weights: token to score; law (rate, size): P(best >= s) = 1 - exp(-size n exp(-rate s))."""

    weights: dict[bytes, float]
    rate: float
    size: float
    logistic: tuple[float, float]
    memo: dict[bytes, float] = field(default_factory=dict, compare=False, repr=False)

    def score_of(self, word: bytes) -> float:
        return max((self.weights.get(t, DRIFT) for t in tokens_of(word)), default=DRIFT)

    def passages(self, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments as word ranges with scores, and the number of words."""
        words = letter_words(text)
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        get = memo.get
        scores = np.fromiter((s if (s := get(w)) is not None else memo.setdefault(w, self.score_of(w)) for w in words), float, len(words))
        places, values = runs(scores)
        return [(places[a], places[b - 1] + 1, s) for a, b, s in maximal_segments(values)], len(words)

    def surprise(self, score: float, n_words: int) -> float:
        """-ln of the chance that a clean text of this length has a segment so high."""
        expected = self.size * max(n_words, 1) * math.exp(-min(self.rate * score, 700))
        return -math.log(max(-math.expm1(-expected), 1e-300))

    def evidence(self, found: list[tuple[int, int, float]], n_words: int) -> float:
        """ln(1 + surprise) of the best of the passages found, plus the excess of the other significant ones."""
        if not found:
            return 0.0
        surprises = sorted((self.surprise(s, n_words) for _, _, s in found), reverse=True)
        return math.log1p(surprises[0] + sum(max(0.0, x - 3.0) for x in surprises[1:]))

    def probability(self, found: list[tuple[int, int, float]], n_words: int) -> float:
        a, b = self.logistic
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * self.evidence(found, n_words) + b))))


def log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least: int = MIN_DOCS, mass: float = 200.0) -> dict[bytes, float]:
    """Token scores under the Dirichlet prior, from document frequencies of both classes."""
    out = {}
    total = n_toxic + n_clean
    for word, y in toxic.items():
        if y < least:
            continue
        x = clean.get(word, 0)
        prior = mass * (x + y) / total
        odds = math.log((y + prior) / (n_toxic + mass - y - prior + 1)) - math.log((x + prior) / (n_clean + mass - x - prior + 1))
        low = odds - 2.58 * math.sqrt(1 / (y + prior) + 1 / (x + prior))
        if low > 0.5:
            out[word] = low
    return out


def fit_law(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Rate and size of the extreme-value law from the best segments of clean texts.

    Maximum likelihood of the exceedances above zero for the rate, and for the size the share
    of words that begin one. Texts without a segment count towards the size.
    """
    positive = best[best > 0]
    rate = (len(positive) + 2) / (positive.sum() + 2)
    size = (len(positive) + 1) / (lengths.sum() + 1)
    return float(rate), float(size)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60) -> tuple[float, float]:
    """Slope, at least 0, and offset by Newton steps on the penalised likelihood of weighted rows.

    Weights count relative to their mean, so the rows weigh against the penalty by their number.
    """
    v = np.ones(len(x)) if weight is None else weight / weight.mean()
    w = np.zeros(2)
    m = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w += np.linalg.solve(m.T @ (m * (v * p * (1 - p))[:, None]) + 0.05 * np.eye(2), m.T @ (v * (y - p)) - 0.05 * w)
    return max(0.0, float(w[0])), float(w[1])


def labelled(labels: DataFrame, label_col: str, fold: Column, id_col: str = "doc_id") -> DataFrame:
    """(id_col, y) of the fold. Labels that are null or contradict each other for an id teach nothing."""
    return labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & fold).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_most")).where("y = _most").select(id_col, "y")


def class_counts(labels: DataFrame, label_col: str, fold: Column, id_col: str = "doc_id") -> dict[int, int]:
    """Labelled documents of the fold by class."""
    return {int(r["y"]): r["count"] for r in labelled(labels, label_col, fold, id_col).groupBy("y").count().collect()}


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, fold: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled documents of each class in the fold.

    Ids are taken in the order of their hash, so the choice depends on nothing else. The chosen
    ids, at most twice ``max_rows``, are broadcast, so the texts are not shuffled.
    """
    once = labelled(labels, label_col, fold, id_col).select(F.col(id_col).alias("_id"), "y")
    count = class_counts(labels, label_col, fold, id_col)
    picked = [first_by_hash(once.where(F.col("y") == c), count.get(c, 0), max_rows) for c in (0, 1)]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, fold: Column, label_col: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on the labelled rows of the fold; without rows of both classes nothing scores.

    Null and empty texts count as documents without words. Labelled ids that no document has,
    and null ids, teach nothing; rows that repeat an id count as often as they come.
    """
    in_labels = class_counts(labels, label_col, fold, id_col)
    rows = training_rows(docs, labels, label_col, fold, max_rows, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        sizes = [0, 0]

        def out():
            words = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])

        for batch in non_empty(batches):
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                seen[y].update({t for w in set(letter_words(text)) for t in tokens_of(w)})
                sizes[y] += 1
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield from out()
                seen[0].clear(), seen[1].clear()
        seen[0][b""], seen[1][b""] = sizes  # the empty word counts the documents
        yield from out()

    counts = map_arrow(rows, count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a weight needs some toxic documents and a raw odds ratio above 1, which few tokens have
    kept = counts.where((F.col("toxic") >= MIN_DOCS) | (F.length("word") == 0)).collect()
    toxic = Counter({bytes(r["word"]): r["toxic"] for r in kept})
    clean = Counter({bytes(r["word"]): r["clean"] for r in kept})
    n_toxic, n_clean = toxic.pop(b"", 0), clean.pop(b"", 0)
    if not n_toxic or not n_clean:
        return ToxicModel({}, 1.0, 1.0, (0.0, -4.0))
    draft = ToxicModel(log_odds(toxic, clean, n_toxic, n_clean), 1.0, 1.0, (1.0, 0.0))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            got = [(max((s for _, _, s in found), default=0.0), n, "|".join(f"{s:.6g}" for _, _, s in found)) for found, n in map(draft.passages, as_bytes(batch.column(0)))]
            tops, ns, alls = zip(*got)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(tops, pa.float64()), pa.array(ns, pa.int64()), pa.array(alls, pa.string())], names=["y", "best", "n", "scores"])

    seen = map_arrow(rows.select("text", F.col("y").cast("int").alias("y")), best, "y int, best double, n long, scores string").collect()
    y = np.array([r["y"] for r in seen], float)
    tops, lengths = np.array([r["best"] for r in seen]), np.array([r["n"] for r in seen], float)
    rate, size = fit_law(tops[y == 0], lengths[y == 0])
    model = ToxicModel(draft.weights, rate, size, (1.0, 0.0))

    got = np.array([model.evidence([(0, 0, float(x)) for x in r["scores"].split("|") if x], r["n"]) for r in seen])
    weight = np.array([max(1.0, in_labels[c] / max_rows) for c in (0, 1)])[y.astype(int)]
    return ToxicModel(draft.weights, rate, size, fit_logistic(got, y, weight))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, score, predicted, passages array of (start, end, score)), one row per input row.

    Passages are word ranges, significant at 1 in 20 for the text's length. Null and empty
    texts have none and the lowest score. Null ids stay null, repeated rows are repeated, an
    empty table gives no rows, other columns are ignored. The model (its size is bounded by the
    training rows) goes to the workers with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        floor = -math.log(0.05)
        for batch in non_empty(batches):
            scores, spans = [], []
            for text in as_bytes(batch.column(1)):
                found, n = m.passages(text)
                scores.append(m.probability(found, n))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if m.surprise(s, n) >= floor])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, pa.list_(span))], names=[id_col, "score", "predicted", "passages"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
