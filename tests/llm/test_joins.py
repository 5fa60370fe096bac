"""Near duplicates, components, media and mixtures against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import components as stars
from scriptloom.llm import lattice, media, minhash, mixing, oracles
from scriptloom.llm.queries import DOMAIN_SQL, WEIGHTS, queries
from test_oracles import compare


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def word_sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


@pytest.mark.parametrize("limit", [stars.BROADCAST_ROWS, 0])
def test_near_duplicates_equal_all_pairs(spark, docs, rows, limit):
    extra = [(10_000 + k, " ".join(f"t{j if (j * 7 + k) % 97 else -k}" for j in range(300))) for k in range(160)]
    extra += [(20_000 + k, "a b c") for k in range(5)] + [(30_000, "a b"), (30_001, "A B"), (30_002, ""), (30_003, None)]
    every = rows[:120] + extra
    df = spark.createDataFrame(every, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, 3, 85, 21, 6, limit=limit).collect()}
    sets = word_sets(every, 3)
    forest = Forest(sets)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                forest.join(a, b)
    assert {i: (r["component_id"], r["n_shingles"], r["kept"]) for i, r in got.items()} == {i: (forest.top(i), len(sets[i]), forest.top(i) == i) for i in ids}
    assert len({forest.top(10_000 + k) for k in range(160)}) < 160


def all_pairs(texts, width, percent):
    sets = word_sets(texts, width)
    forest, ids = Forest(sets), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                forest.join(a, b)
    return forest


@pytest.mark.parametrize("limit, block, sig_block, block_bytes", [(stars.BROADCAST_ROWS, 8, 16, minhash.BLOCK_BYTES), (0, 8, 16, minhash.BLOCK_BYTES), (0, 10_000, 10_000, 8_000), (stars.BROADCAST_ROWS, 10_000, 10_000, 8_000)])
def test_groups_of_many_chunks(spark, monkeypatch, limit, block, sig_block, block_bytes):
    """Chains of texts that drift: all are in one group, most links are not to its first chunk. Chunks are bounded by members or by bytes."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SIG_BLOCK", sig_block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block_bytes)
    across = []
    named = minhash.linked_across
    monkeypatch.setattr(minhash, "linked_across", lambda *a: across.append(1) or named(*a))
    rng = random.Random(2)
    words, texts = [f"v{i}" for i in range(120)], []
    for k in range(150):
        texts.append((k, " ".join(words)))
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            words[rng.randrange(len(words))] = f"n{k}x{rng.randrange(10**6)}"
    forest = all_pairs(texts, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85, 21, 6, limit=limit).collect()}
    assert got == {i: forest.top(i) for i, _ in texts} and 10 < len(set(got.values())) < 120
    assert across


@pytest.mark.parametrize("width, percent, bands, rows, n_words", [(3, 85, 21, 6, 372), (5, 80, 25, 5, 454)])
def test_recall_at_the_threshold(spark, width, percent, bands, rows, n_words):
    """Pairs that share exactly the threshold: ten words apart, each of which changes ``width`` shingles."""
    rng, texts = random.Random(width), []
    for k in range(1500):
        words = [f"{rng.randrange(10**9):x}" for _ in range(n_words)]
        texts.append((2 * k, " ".join(words)))
        for j in range(10):
            words[20 + j * 30] = f"z{k}x{j}"
        texts.append((2 * k + 1, " ".join(words)))
    sets = word_sets(texts[:2], width)
    assert 100 * len(sets[0] & sets[1]) == percent * len(sets[0] | sets[1])
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), width, percent, bands, rows).where("not kept").count()
    assert got >= 0.99 * 1500


def test_documents_of_a_million_words(spark, monkeypatch):
    """Sets of 8 MB each: three of one group are three chunks."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 8 << 20)
    text = "transform(sequence(1, 1000000), x -> case when x % 100000 = 7 then concat('v', id) else cast(x as string) end)"
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.expr(f"array_join({text}, ' ')").alias("text"))
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, 3, 85, 21, 6).collect())
    assert got == [(k, 999_998, 0, k == 0) for k in range(3)]


def test_rows_by_a_bitmap_of_ids(spark, monkeypatch):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("k"), (F.col("id") * 3).alias("x"))
    ids = spark.range(0, 20_000, 3).select(F.col("id").alias("k"))
    want = {r["x"] for r in df.collect() if r["k"] is None or r["k"] % 3}
    for limit in (stars.BROADCAST_ROWS, 0):
        rest = stars.without(df, "k", ids, 6667, limit=limit)
        assert rest.columns == df.columns and sorted(r["x"] for r in rest.collect()) == sorted(want)
    maybe = {r["k"] for r in stars.maybe_in(df, "k", ids, 6667).collect()}
    assert maybe >= {k for k in range(0, 20_000, 3) if k % 100 != 7} and len(maybe) < 8000 and None not in maybe
    monkeypatch.setattr(stars, "MOST_ID_BITS", 1 << 10)  # a full map costs rows, never decides wrongly
    assert sorted(r["x"] for r in stars.without(df, "k", ids, 6667, limit=0).collect()) == sorted(want)
    assert stars.without(df, "k", ids.limit(0), 0, limit=-1).count() == 20_000


@pytest.mark.parametrize("limit", [stars.BROADCAST_ROWS, 0])
def test_components_of_paths_and_stars(spark, limit):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, None), (900, 2), (2, 900)]
    random.Random(1).shuffle(edges)
    found, n = stars.components(spark.createDataFrame(edges, "u long, v long"), limit)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {i: 100 for i in range(101, 161)} | {k: 500 for k in range(501, 560)} | {900: 2} and n == len(got)


VECTORS = "vec_id long, embedding array<double>, label int"


def true_links(v, label, threshold):
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = (unit @ unit.T >= threshold) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(close, False)
    forest = Forest(range(len(v)))
    for a, b in zip(*np.nonzero(close)):
        forest.join(int(a), int(b))
    return close, forest


@pytest.mark.parametrize("limit, most_bits", [(stars.BROADCAST_ROWS, lattice.MOST_BITS), (0, 1 << 16)])
def test_near_vectors_equal_all_pairs(spark, limit, most_bits):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 64)) * 0.05, base[:1] + rng.normal(size=(300, 64)) * 0.12, np.repeat(base[3:4], 6, axis=0), base[5:6] * 3])
    label = [int(x) for x in rng.integers(0, 2, len(v))]
    every = [(i, x.tolist(), lab) for i, (x, lab) in enumerate(zip(v, label))]
    odd = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, v[0].tolist(), None), (1004, [None] + [1.0] * 63, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [float("inf")] + [1.0] * 63, 0)]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(every + odd, VECTORS), limit=limit, most_bits=most_bits).collect()}
    close, forest = true_links(v, label, 0.93)
    found, true = sum(got[i]["n_links"] for i in range(len(v))), int(close.sum())
    assert all(got[i]["n_links"] <= int(close[i].sum()) for i in range(len(v)))
    assert found >= 0.99 * true
    assert sum(got[i]["component_id"] != forest.top(i) for i in range(len(v))) <= 2
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008))
    assert got[1007]["component_id"] == 1006 and got[1006]["n_links"] == 1


@pytest.mark.parametrize("small, block", [(256, 1024), (64, 128), (4, 64)])
def test_dense_cells_are_compared_in_blocks(spark, monkeypatch, small, block):
    """A group of 900 different near copies of one label: one cell has them all, cut into one block or many."""
    monkeypatch.setattr(lattice, "SMALL", small)
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1, 32)) + rng.normal(size=(900, 32)) * rng.uniform(0.02, 0.35, size=(900, 1))
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], VECTORS)).collect()}
    close, forest = true_links(v, [1] * len(v), 0.93)
    assert all(got[i]["n_links"] <= int(close[i].sum()) for i in range(len(v)))
    assert sum(got[i]["n_links"] for i in range(len(v))) >= 0.999 * close.sum() > 100_000
    assert sum(got[i]["component_id"] != forest.top(i) for i in range(len(v))) <= 2


@pytest.mark.parametrize("dims, threshold", [(16, 0.9), (64, 0.8), (128, 0.97)])
def test_other_thresholds_and_lengths(spark, dims, threshold):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    near = np.concatenate([base + rng.normal(size=base.shape) * f for f in (0.1, 0.25, 0.5, 0.75)])
    v = np.concatenate([base, near])
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], VECTORS), threshold=threshold).collect()}
    close, _ = true_links(v, [1] * len(v), threshold)
    assert all(got[i]["n_links"] <= int(close[i].sum()) for i in range(len(v)))
    assert sum(got[i]["n_links"] for i in range(len(v))) >= 0.99 * close.sum() > 50


def test_odd_vector_tables(spark):
    clash = "vec_id long, embedding array<float>, label int, id long, cell long, rep long, digest string, vector string, n int, home string, v long, u long"
    rest = (1, 2, 3, "d", "v", 4, "h", 5, 6)
    x, y = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(5, x, 1, *rest), (5, x, 1, *rest), (7, x, 1, *rest), (None, x, 1, *rest), (8, y, 1, *rest), (9, [0.0, 0.0, 1.0], 1, *rest), (10, [-0.0, 0.0, 1.0], 1, *rest)]
    got = sorted((tuple(r) for r in lattice.near_vectors(spark.createDataFrame(rows, clash)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False)], key=str)
    assert lattice.near_vectors(spark.createDataFrame([], clash)).count() == 0
    nothing = spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0], None)], VECTORS)
    assert sorted(map(tuple, lattice.near_vectors(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    with pytest.raises(ValueError):
        lattice.near_vectors(nothing, threshold=0.0)


def recall(dims, threshold, count):
    rng = np.random.default_rng(7)
    u = lattice._unit(rng.normal(size=(count, dims)))
    w = rng.normal(size=u.shape)
    w = lattice._unit(w - (w * u).sum(axis=1)[:, None] * u)
    salt = np.zeros(len(u), np.uint64)
    sides = [lattice.cells(y, salt, lattice.TABLES, lattice.VISITS, lattice.scale_for(threshold)) for y in (u, threshold * u + (1 - threshold**2) ** 0.5 * w)]
    return lattice._met_before(lattice.TABLES, *sides[0], *sides[1]).mean()


def test_lattice_decodes_to_the_nearest_point():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    gap = x - lattice.nearest_e8(x)
    assert all((g @ g) <= ((g - lattice.ROOTS) ** 2).sum(axis=1).min() + 1e-9 for g in gap)


@pytest.mark.parametrize("dims", [8, 16, 64, 384])
@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9, 0.93, 0.99])
def test_lattice_misses_few_pairs_at_any_threshold(dims, threshold):
    assert recall(dims, threshold, 2000) >= 0.995


def test_lattice_misses_few_pairs_at_the_threshold():
    assert recall(64, 0.93, 8000) >= 0.998


def test_trees_span_what_links_join():
    rng = np.random.default_rng(4)
    trees, forest, count = lattice.Trees(300), Forest(range(300)), 0
    for _ in range(10):
        a, b = rng.integers(0, 300, 25), rng.integers(0, 300, 25)
        trees.add(a, b)
        for x, y in zip(a.tolist(), b.tolist()):
            count += forest.top(x) != forest.top(y)
            forest.join(x, y)
    assert len(trees.links) == count and [int(x) for x in trees.label] == [forest.top(i) for i in range(300)]


def whole_lines(text):
    return [" ".join(line.split()) for line in (text or "").splitlines() if line.strip()]


def page_items(text):
    """What a page of the text shows, from its lines."""
    lines = whole_lines(text)
    first = [("text", lines[0], None)] if lines else []
    return [*first, ("media", None, lines[1] if len(lines) > 1 else None), *(("text", line, None) for line in lines[2:]), ("media", None, "again")]


def described(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media.to_wav(payload)).hexdigest()


def described_row(r):
    return r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]


CONTRACT = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_media_payloads(spark, sf_dir, rows):
    df = queries()["op6_media"](spark, sf_dir)
    assert df.columns[: len(CONTRACT)] == CONTRACT
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert described_row(got[i]) == described(t)
        items = page_items(t)
        assert got[i]["n_items"] == len(items) and got[i]["positions"] == ",".join(str(k) for k, x in enumerate(items) if x[0] == "media")
    assert sum(not r["positions"].startswith("0") for r in got.values()) > 0.9 * len(rows)


def test_media_query_on_odd_rows(spark, edge_docs, no_docs, tmp_path):
    for name, docs, count in (("edge", edge_docs, 11), ("none", no_docs, 0)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries()["op6_media"](spark, f"{tmp_path}/{name}").collect()
        want = sorted(((r["doc_id"] or 0, *described(r["text"])) for r in docs.select("doc_id", "text").collect()), key=str)
        assert len(got) == count and sorted(((r["doc_id"] or 0, *described_row(r)) for r in got), key=str) == want
    assert {r["positions"] for r in queries()["op6_media"](spark, f"{tmp_path}/edge").where("doc_id in (1, 2, 3)").collect()} == {"0,1"}


def test_stored_bytes_are_resolved_and_fetched(spark, docs, rows, tmp_path):
    store = media.store_media(docs, "text", f"{tmp_path}/store")
    index = media.index_media(store)
    assert index.count() == len({t for _, t in rows}) < len(rows) == store.count()
    refs = media.references(media.interleave(media.pages_of(docs, "doc_id", "text"), "doc_id", "html"), ["doc_id"])
    lost = spark.createDataFrame([(-1, b"x" * 32, [3], ["c"])], "doc_id long, digest binary, positions array<int>, captions array<string>")
    found = media.fetch(media.resolve(refs.unionByName(lost), index), store)
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[-1]["media"] is None and got[-1]["n_bytes"] is None and got[-1]["positions"] == [3] and got[-1]["captions"] == ["c"]
    for i, t in rows:
        back = media.from_wav(bytes(got[i]["media"]))
        assert back == media.payload_of(t.encode()) and zlib.crc32(back[-64:]) == got[i]["tail_crc32"]
        want = [(k, x[2]) for k, x in enumerate(page_items(t)) if x[0] == "media"]
        assert list(zip(got[i]["positions"], got[i]["captions"])) == want


def test_pages_hold_the_whole_text(spark, docs, rows):
    texts = dict(rows)
    for r in media.interleave(media.pages_of(docs, "doc_id", "text"), "doc_id", "html").collect():
        assert [(x["kind"], x["text"], x["caption"]) for x in r["items"]] == page_items(texts[r["doc_id"]])
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))


@pytest.mark.parametrize(
    "page, items",
    [
        ("<p>One <b>two</b></p><figure><img src='a.png' alt='x'><figcaption>Cap &amp; tion</figcaption></figure><script>no</script><p>three<img src='b.png' alt='alt'>four", [("text", "One two"), ("media", "a.png", "Cap & tion"), ("text", "three"), ("media", "b.png", "alt"), ("text", "four")]),
        ("<figure><figcaption>cap</figcaption><img src=a><img src=b></figure>", [("media", "a", "cap"), ("media", "b", "cap")]),
        ("<figure><img src=a><figcaption>cap</figure><p>rest</p>", [("media", "a", "cap"), ("text", "rest")]),
        ("<figure><img src=a alt=z><figcaption>never closed", [("media", "a", "never closed")]),
        ("<article><figure><img src=a><figcaption>cap</article><p>rest", [("media", "a", "cap"), ("text", "rest")]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>t", [("media", "a", "out"), ("media", "b", "in"), ("text", "t")]),
        ("<p>a</p><noscript>x<p>b</p>", [("text", "a"), ("text", "x"), ("text", "b")]),
        ("a<noscript>x<img src=q></noscript>b<template>y</template>c", [("text", "abc")]),
        ("<figcaption>loose</figcaption>x", [("text", "loose"), ("text", "x")]),
        ("<figure></figure></figure></p></article>", []),
        ("", []),
    ],
)
def test_pages_keep_order_and_captions(page, items):
    want = [(i, kind, value if kind == "text" else None, value if kind == "media" else None, caption[0] if caption else None) for i, (kind, value, *caption) in enumerate(items)]
    assert media.parse_page(page) == want


def test_raw_pages_are_parsed(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    seqs = media.interleave(pages, "page_id", "html").collect()
    assert len(seqs) == pages.count() and all([x["position"] for x in r["items"]] == list(range(len(r["items"]))) for r in seqs)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries()[name], oracles.oracle_sql()[name]) > 0


def test_mixture_budgets(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10, 100.0), ("a", "en", "s2", 10, 900.0), ("a", "de", "s3", 10, 1000.0), ("b", "en", "s4", 10, 2000.0)], "domain string, lang string, source string, n_rows long, tokens double")
    got = {r["source"]: r["got"] for r in mixing.leaf_budgets(leaves, {"domain": {"a": 1, "b": 1}, "lang": {}, "source": {}}, 50, 1).collect()}
    assert got == {"s1": 100.0, "s2": 400.0, "s3": 500.0, "s4": 1000.0}  # s1's shortage goes to its sibling s2


MIX_COLUMNS = "doc_id long, text string, lang string, source string, n_tokens long, epoch int, whole int, got double"


def mixture_rows():
    rng = random.Random(11)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src7", "x", None]), 1, 2, 3, 4.0) for i in range(600)]
    return rows + rows[:40] + [(None, "a b", "en", "src0", 1, 2, 3, 4.0)] * 3 + [(700, None, "en", "src0", 1, 2, 3, 4.0)]


@pytest.mark.parametrize("percent, epochs", [(35, 1), (120, 3), (1000, 2)])
def test_mixture_is_the_same_by_broadcast_and_by_shuffle(spark, percent, epochs):
    """Repeated rows tie; which of them is taken does not change what the mixture holds."""
    df = spark.createDataFrame(mixture_rows(), MIX_COLUMNS)
    ways = [mixing.mix(df, F.expr(DOMAIN_SQL), WEIGHTS, percent, epochs, limit=n, payload=p).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch") for n, p in ((mixing.BROADCAST_LEAVES, None), (0, None), (0, ["text"]))]
    rows = [sorted(map(str, w.collect())) for w in ways]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    taken = ways[0].agg(F.sum("n_tokens")).first()[0]
    whole = sum(len((r[1] or "").split()) for r in mixture_rows())
    assert taken <= whole * percent // 100 and taken <= whole * epochs


def test_mixture_takes_prefixes_of_the_seeded_order(spark):
    """Within a leaf no text is left out whose key comes before one that the last epoch takes."""
    df = spark.createDataFrame(mixture_rows()[:600], MIX_COLUMNS)
    got = mixing.mix(df, F.expr(DOMAIN_SQL), WEIGHTS, 35, 1, seed=17).collect()
    taken = {r["doc_id"] for r in got}
    domain = lambda s: "web" if s == "src0" else "books" if s == "src1" else "forums" if s == "src7" else "reference"
    leaves = collections.defaultdict(list)
    for i, text, lang, source, *_ in mixture_rows()[:600]:
        leaves[domain(source), lang or "", source or ""].append((hashlib.md5(f"17:0:{i}".encode()).hexdigest(), i, len(text.split())))
    for rows in leaves.values():
        rows.sort()
        marks = [i in taken for _, i, _ in rows]
        last = max((k for k, m in enumerate(marks) if m), default=-1)
        assert all(marks[: last + 1])


def test_one_id_on_many_rows_is_cut_where_the_budget_ends(spark):
    """100,000 rows of one id and length, a third of which the budget holds; one row a part is numbered at most."""
    same = spark.range(0, 100_000, 1, 7).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.col("id").alias("url"))
    for payload in (None, ["url"]):
        got = mixing.mix(same, F.expr(DOMAIN_SQL), WEIGHTS, 34, 1, payload=payload)
        assert got.count() == 34_000 and (payload is None or got.select("url").distinct().count() == 34_000)
    null = same.withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mix(null, F.expr(DOMAIN_SQL), WEIGHTS, 150, 2).count() == 150_000


def test_edge_cases(edge_docs, no_docs):
    near = minhash.near_duplicates(edge_docs).collect()
    assert len(near) == edge_docs.count()
    by = collections.defaultdict(set)
    for r in near:
        by[r["doc_id"]].add((r["component_id"], r["kept"], r["n_shingles"]))
    assert by[5] == {(5, True, 2)} and by[6] == {(5, False, 2)} and by[None] == {(None, True, 2)} and by[2] == {(2, True, 0)}
    assert minhash.near_duplicates(no_docs).count() == 0
    mixed = mixing.mix(edge_docs, F.expr(DOMAIN_SQL), WEIGHTS, 60, 2)
    assert mixed.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"] and mixed.count() > 0
    assert mixing.mix(no_docs, F.expr(DOMAIN_SQL), WEIGHTS, 60, 2).count() == 0
    assert media.interleave(edge_docs, "doc_id", "text").count() == edge_docs.count()
