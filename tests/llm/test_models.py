"""Toxicity, quality and language model: brute force, exact counts, held-out accuracy."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scriptloom.llm import lm, quality, toxicity
from scriptloom.llm.common import crc_fold, first_by_hash
from scriptloom.llm.queries import queries

BIG = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Maximal scoring segments by their definition: take the best, shortest first, then both sides."""

    def best(a, b):
        top = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        return [] if top is None or top[0] <= 0 else best(a, top[3]) + [(top[3], top[4], top[0])] + best(top[4], b)

    return best(0, len(scores))


def test_segments_equal_definition():
    rng = random.Random(4)
    for _ in range(400):
        scores = [float(rng.choice([-5, -3, -2, -1, 1, 2, 3, 4])) for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(scores)
        assert sum(s for *_, s in got) == sum(s for *_, s in brute_segments(scores)), scores
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_segments_themselves_equal_definition():
    """Without ties the segments, not only their scores, are those of the definition."""
    rng = random.Random(14)
    for _ in range(400):
        scores = [rng.uniform(-5, 4) for _ in range(rng.randint(0, 16))]
        got, want = toxicity.maximal_segments(scores), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want], scores
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_log_odds_equal_their_formula():
    toxic, clean = collections.Counter({b"vile": 40, b"tree": 50, b"rare": 7}), collections.Counter({b"vile": 2, b"tree": 400})
    got = toxicity.log_odds(toxic, clean, 100, 900, least=8)
    share = 200 * 42 / 1000  # the prior mass by the background frequency
    odds = math.log((40 + share) / (100 + 200 - 40 - share + 1)) - math.log((2 + share) / (900 + 200 - 2 - share + 1))
    assert got.keys() == {b"vile"} and abs(got[b"vile"] - (odds - 2.58 * math.sqrt(1 / (40 + share) + 1 / (2 + share)))) < 1e-12
    assert b"rare" in toxicity.log_odds(toxic, clean, 100, 900, least=2)


def test_law_and_calibration_are_the_most_likely(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    best = np.where(rng.random(40_000) < 0.1, rng.exponential(1 / 1.7, 40_000), 0.0)
    rate, size = toxicity.fit_law(best, np.full(40_000, 50.0))
    assert abs(rate - 1.7) < 0.1 and abs(size - 0.1 / 50) < 2e-4
    model = toxicity.ToxicModel({}, rate, size, (1.0, 0.0))
    over = [float((best > s).mean()) for s in (0.5, 1.0, 2.0)]
    assert all(abs(math.exp(-model.surprise(s, 50)) - o) < 0.01 for s, o in zip((0.5, 1.0, 2.0), over))
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    weight = np.where(y == 1, 1.0, 3.0)
    a, b = toxicity.fit_logistic(x, y, weight)
    v = weight / weight.mean()
    loss = lambda a, b: float((v * np.logaddexp(0, -(2 * y - 1) * (a * x + b))).sum() + 0.025 * (a * a + b * b))
    assert all(loss(a, b) <= loss(a + d, b + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_risk_slopes_are_those_of_the_risk():
    """Numerical slopes of the non-negative risk; where its second term is negative, of its rise."""
    import numpy as np

    rng = np.random.default_rng(0)
    soft = lambda z: np.logaddexp(0, z).mean()
    signs = set()
    for _ in range(30):
        zp, zu, prior = rng.normal(rng.uniform(-2, 4), 1, 7), rng.normal(rng.uniform(-3, 2), 1, 9), float(rng.uniform(0.2, 0.9))
        negative = lambda p, u: soft(u) - prior * soft(p)
        signs.add(negative(zp, zu) >= 0)
        value = (lambda p, u: prior * soft(-p) + negative(p, u)) if negative(zp, zu) >= 0 else (lambda p, u: -negative(p, u))
        dp, du = quality.risk_slopes(zp, zu, prior)
        for z, d, f in ((zp, dp, lambda x: value(x, zu)), (zu, du, lambda x: value(zp, x))):
            for i in range(len(z)):
                step = np.eye(len(z))[i] * 1e-5
                assert abs((f(z + step) - f(z - step)) / 2e-5 - d[i]) < 1e-6
    assert signs == {True, False}


def test_layer_slopes_are_those_of_the_outputs():
    import numpy as np

    rng = np.random.default_rng(1)
    x, dz = rng.normal(size=(6, 4)), rng.normal(size=6)
    layers = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    value = lambda ls: float(dz @ quality.forward(ls, x)[1])
    for k, slope in enumerate(quality._gradient(layers, x, dz, 0.0)):
        for at in np.ndindex(layers[k].shape):
            up, down = ([a.copy() for a in layers] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((value(up) - value(down)) / 2e-6 - slope[at]) < 1e-6


def test_prior_bins_cover_every_text(spark, docs):
    """The histogram that the prior is read off holds each text of the fold, and few large or many small shards give about the same prior."""
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    big = spark.read.parquet(f"{BIG}/documents.parquet")
    table = quality.featurise(big)
    priors = [quality.train(table, labels, lambda c: crc_fold(c, 4) != 2, shard_rows=n).prior for n in (2000, 16_384)]
    share = big.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert abs(priors[0] - priors[1]) < 0.1 and all(abs(p - share) < 0.15 for p in priors)


def test_first_by_hash_is_what_ordering_all_gives(spark):
    ids = spark.range(5000).select((F.col("id") % 1700).alias("_id"))
    order = spark.range(1700).select(F.col("id").alias("_id")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(300)
    for count in (5000, 100_000_000):
        assert {r[0] for r in first_by_hash(ids, count, 300).collect()} == {r[0] for r in order.collect()}
    same = spark.range(5000).select(F.lit(4).alias("_id"))
    assert first_by_hash(same, 5000, 300).count() == 1 and first_by_hash(same.limit(0), 0, 300).count() == 0


def held_out(spark, name, label):
    scored = queries()[name](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out")
    rows = [(r["score"], r["predicted"], r[label]) for r in scored.select("score", "predicted", label).collect()]
    pos, neg = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    recall = sum(p for _, p, y in rows if y == 1) / len(pos)
    false = sum(p for _, p, y in rows if y == 0) / len(neg)
    return auc, recall, false


def test_toxicity_held_out(spark):
    auc, recall, false = held_out(spark, "op5_toxicity", "toxic")
    assert auc > 0.93 and recall > 0.8 and false < 0.01


def test_quality_held_out(spark):
    auc, recall, false = held_out(spark, "op8_quality", "quality")
    assert auc > 0.98 and recall > 0.99 and false < 0.08


def test_prior_estimate_is_near_the_share():
    import numpy as np

    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, 20_000), rng.normal(-2, 1, 4_000)
    web = np.concatenate([good[8000:], bad])
    grid = quality.prior_grid(good[:8000])
    bins = quality.binned(web, grid)
    assert bins.sum() == len(web) and [int(bins[k + 1 :].sum()) for k in (0, 50, 199)] == [int((web >= grid[k]).sum()) for k in (0, 50, 199)]
    assert abs(quality.estimate_prior(good[:8000], bins, grid) - 0.75) < 0.05


@pytest.mark.parametrize("heavy, part_bytes", [(lm.HEAVY, lm.PART_BYTES), (500, lm.PART_BYTES), (lm.HEAVY, 0)])
def test_language_model_counts(docs, rows, heavy, part_bytes, monkeypatch):
    """Exact counts, and a score near that of exact levels, with the filter broadcast and with it in its segments."""
    monkeypatch.setattr(lm, "POSITIONS", 20_000)
    train = ~(crc_fold(F.col("doc_id"), 5) == 1)
    got = {r["doc_id"]: r for r in lm.score_texts(docs, train, heavy=heavy, part_bytes=part_bytes, segment_bytes=1 << 16).collect()}
    texts = [(i, t.encode().lower().split() + [lm.END]) for i, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for i, w in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(w)
            two.update(zip([lm.END, *w], w))
    total, kinds = sum(one.values()), len(one)
    norm = total + 0.5 * (kinds + 1)
    level = lambda c: 2.0 ** (math.frexp(c)[1] - 1) * 1.5 - 0.5 if c else 0.0
    drift = []
    for i, w in texts:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), total)
        assert abs(r["base_score"] - sum(math.log10((one[x] + 0.5) / norm) for x in w)) < 1e-6
        want = 0.0
        for h, x in zip([lm.END, *w], w):
            unigram, history = (level(one[x]) + 0.5) / norm, level(one[h])
            want += math.log10(lm.LAMBDA * min(level(two[h, x]), history) / history + (1 - lm.LAMBDA) * unigram if history else unigram)
        drift.append(((r["score"] - want) / len(w), len(w)))
    # false positives of the filter raise a level by one: about 2 % of probes at 8 bits an entry and 5 hashes,
    # each worth up to 5.5 in a text of nothing but unknown pairs; measured at most 0.16 a token
    assert abs(sum(d for d, _ in drift) / len(drift)) < 0.05
    assert all(abs(d) < 0.25 for d, n in drift if n >= 50) and all(abs(d) < 0.5 for d, _ in drift)


def test_filter_in_segments_scores_like_the_broadcast_filter(docs, monkeypatch):
    monkeypatch.setattr(lm, "POSITIONS", 20_000)
    train = ~(crc_fold(F.col("doc_id"), 5) == 1)
    a, b = ({r["doc_id"]: r for r in lm.score_texts(docs, train, part_bytes=n, segment_bytes=1 << 14, heavy=5000).collect()} for n in (lm.PART_BYTES, 0))
    assert a.keys() == b.keys()
    for i, r in a.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (b[i]["n_tokens"], b[i]["n_known"], b[i]["train_tokens"])
        assert abs(r["score"] - b[i]["score"]) < 1e-6 * max(1, abs(r["score"])) and abs(r["base_score"] - b[i]["base_score"]) < 1e-6 * max(1, abs(r["base_score"]))


def test_common_words_and_pairs_are_asked_of_no_segment():
    """Without the whole filter, a known word or pair is no question, and its level goes along."""
    import numpy as np
    import pyarrow as pa

    text = lm.text_hashes(b"the cat the cat the dog")
    words = np.sort(text[[0, 1]])  # the, cat
    pair = lm.mix(text[:1], text[1:2])
    key = (lm.segment_of(pair, 64).astype(np.uint64) << np.uint64(40)) | (pair & lm.LOW)
    levels = np.array([2, 3], np.uint8), key, np.array([5], np.uint8)
    own, *asked = lm._rows(0, pa.array([1]), [text], 64, (words, np.array([3, 5])), 10.0, None, 9, 9, levels).to_pylist()
    assert sum(len(r["words"]) for r in asked) == 2 * 8  # dog, the end
    assert sum(len(r["pairs"]) for r in asked) == 4 * 5  # end the, cat the, the dog, dog end
    assert sorted(own["word_known"]) == [2, 3, lm.ASKED, lm.ASKED] and sorted(own["pair_known"]) == [5] + [lm.ASKED] * 4


def test_filter_levels_are_never_too_low():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 50_000, np.uint64)
    counts = 2 ** rng.integers(0, 12, len(keys))
    bits = np.frombuffer(lm.filter_of(keys, counts), np.uint8)
    ask = lambda k: lm.levels_in(bits, np.zeros(len(k), np.int64), np.full(len(k), 8 * len(bits)), k)
    assert (ask(keys) >= lm.level_of(counts)).all() and (ask(keys) == lm.level_of(counts)).mean() > 0.9
    assert (ask(rng.integers(0, 1 << 40, 50_000, np.uint64)) > 0).mean() < 0.03


def test_stretch_rows_are_spread_and_words_asked_once():
    """Texts rows of many partitions go to many segments, and an unknown word is one question however often it occurs."""
    import numpy as np
    import pyarrow as pa

    text = lm.text_hashes(b"odd " * 5000 + b"other")
    ask = lambda place: lm._rows(place, pa.array([1, 2]), [text, text], 64, (np.empty(0, np.uint64), np.empty(0, np.int64)), 10.0, lm.LevelFilter(64, {}), 0, 0).to_pylist()
    homes = collections.Counter(ask(p << 32)[0]["segment"] for p in range(211))
    assert max(homes.values()) <= 12 and len(homes) > 50
    assert sum(len(r["words"] or b"") for r in ask(5)) == 3 * 8 and sum(len(r["pairs"] or b"") for r in ask(5)) == 0


def test_edge_cases(spark, edge_docs, no_docs):
    model = toxicity.ToxicModel({b"idiot": 4.0}, 1.0, 0.01, (1.0, -4.0))
    assert toxicity.score_toxicity(edge_docs, model).count() == edge_docs.count()
    labels = spark.createDataFrame([(4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    table = quality.featurise(edge_docs)
    scored = quality.score_quality(table, quality.train(table, labels, lambda c: F.lit(True))).collect()
    by = {k: {r["score"] for r in scored if r["doc_id"] == k} for k in range(1, 10)}
    assert len(scored) == edge_docs.count() and sum(r["doc_id"] is None for r in scored) == 1
    assert by[1] == by[2] == by[3] and len(by[5]) == 1 and by[5] == by[6] and len(by[1]) == 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    half = quality.score_quality(table, quality.train(table, labels.limit(0), lambda c: F.lit(True))).collect()
    assert {r["score"] for r in half} == {0.5} and {r["predicted"] for r in half} == {0}
    assert toxicity.train(edge_docs, labels, F.lit(True)).weights == {}
    assert quality.train(quality.featurise(no_docs), labels, lambda c: F.lit(True)).prior == 0.5
    scored = lm.score_texts(edge_docs, F.lit(True)).collect()
    assert len(scored) == edge_docs.count()
    assert all(r["n_tokens"] == 1 for r in scored if r["doc_id"] in (1, 2, 3))
    assert lm.score_texts(no_docs, F.lit(True)).count() == 0
    assert all(r["n_known"] == 0 for r in lm.score_texts(edge_docs, F.lit(False)).collect())


def test_toxicity_base_rate_does_not_depend_on_the_bound(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1100):
        toxic = int(i % 11 == 0)
        words = [rng.choice(["tree", "river", "stone", "cloud", "lamp"]) for _ in range(12)]
        if rng.random() < (0.7 if toxic else 0.1):
            words[5] = "vile"
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, bounded = (toxicity.train(docs, docs.select("doc_id", "toxic"), F.lit(True), max_rows=n) for n in (2000, 100))
    odds = [m.logistic[0] * m.evidence(*m.passages(b"tree river vile stone")) + m.logistic[1] for m in (whole, bounded)]
    assert abs(odds[0] - odds[1]) < 0.8  # without weights the bound adds ln(10)
