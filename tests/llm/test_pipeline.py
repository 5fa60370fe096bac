"""Each stage of the pipeline on its own input."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import CLASH, edge_rows
from scriptloom.llm import bpe, quality
from scriptloom.llm.queries import WEIGHTS
from scriptloom.session import checkpoint_folder
from test_joins import Forest, word_sets
from test_spans import plain_pii


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("pipeline"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs)
    return out


def test_columns_and_ids(stages):
    for name, (before, after) in stages.items():
        if name != "bpe":
            assert sorted(after.columns) == sorted(before.columns)
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}


def test_near_copies_go(stages):
    before, after = ([(r["doc_id"], r["text"]) for r in df.collect()] for df in stages["near_dups"])
    sets, ids = word_sets(before, 5), sorted(i for i, _ in before)
    forest = Forest(ids)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                forest.join(a, b)
    assert sorted(i for i, _ in after) == [i for i in ids if forest.top(i) == i]


def test_personal_data_is_masked(stages):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in stages["pii"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not [s for s in plain_pii(r["text"]) if s[0] == "email"]
        assert r["n_chars"] == len(r["text"])
        if not plain_pii(before[i]["text"]):
            assert r["text"] == before[i]["text"]


def test_rejected_documents_go(spark, sf_dir, stages):
    """The stage keeps what its model scores at 0.7 or more, recomputed text by text."""
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in stages["quality"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(quality.featurise(stages["quality"][0]), labels, lambda c: F.lit(True))
    w, b, v, c = model.layers
    kept = set()
    for i, r in before.items():
        x = quality.features((r["text"] or "").encode()).astype(np.float32)
        z = np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ w + b) @ v + c[0]
        if 1 / (1 + np.exp(-z)) >= 0.7:
            kept.add(i)
    assert after.keys() == kept and 0 < len(kept) < len(before)
    assert all(after[i] == before[i] for i in kept)
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(good.get(i) == 1 for i in kept) >= 0.95 * sum(good.get(i) == 1 for i in before)


def shared(budget, children):
    """A budget by weight among (name, weight, cap): who is short first gets all, the others share the rest."""
    out, left = {}, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while left:
        rate = budget / sum(w for _, w, _ in left)
        name, w, cap = left[0]
        if cap > rate * w:
            return out | {n: float(int(rate * x)) for n, x, _ in left}
        out[name] = cap
        budget -= cap
        left = left[1:]
    return out


def plain_mixture(rows, percent, seed):
    """Rows (id, text, lang, source) that one epoch takes, by plain budgets and sorted prefixes."""
    domain = lambda s: "web" if s == "src0" else "books" if s in {f"src{i}" for i in range(1, 7)} else "forums" if s in {f"src{i}" for i in range(7, 14)} else "reference"
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[domain(r[3]), r[2] or "", r[3] or ""].append((hashlib.md5(f"{seed}:0:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, len((r[1] or "").encode().split()), r))
    size = {k: float(sum(x[2] for x in v)) for k, v in leaves.items()}
    budget = {(): float(int(sum(size.values()) * percent // 100))}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in {k[:depth] for k in leaves}:
            names = {k[depth] for k in leaves if k[:depth] == parent}
            children = [(n, float(WEIGHTS[level].get(n, 1)), sum(v for k, v in size.items() if k[: depth + 1] == (*parent, n))) for n in names]
            budget |= {(*parent, n): got for n, got in shared(budget[parent], children).items()}
    taken = []
    for k, held in leaves.items():
        left = budget[k]
        if left == size[k]:
            taken += [x[3] for x in held]
            continue
        for x in sorted(held, key=lambda x: x[:3]):
            left -= x[2]
            if left < 0:
                break
            taken.append(x[3])
    return taken


def test_mixture_is_that_of_plain_budgets(stages):
    before, after = ([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()] for df in stages["mixing"])
    assert sorted(after, key=str) == sorted(plain_mixture(before, corpus_pipeline.MIX_PERCENT, 17), key=str)
    size = lambda rows: sum(len(r[1].encode().split()) for r in rows)
    assert 0.6 * size(before) < size(after) <= 0.9 * size(before) + 1


def test_ids_are_those_of_the_library(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    checkpoint_folder(spark)
    got = sorted(tuple(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(tuple(r["ids"]) for r in stages["bpe"][1].collect())


def test_every_column_is_handed_on(spark, sf_dir):
    """Columns under the names that operators use come through with their values, nulls as nulls."""
    columns = CLASH + ", domain string, url string, whole int, held_0 string"
    rows = [(*r, "mine", f"u{k}", k, None) for k, r in enumerate(edge_rows())]
    docs = spark.createDataFrame(rows, columns)
    stage = dict(corpus_pipeline.STAGES)
    every = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert set(every(stage["quality"](spark, docs, sf_dir))) <= set(every(docs))
    near = stage["near_dups"](spark, docs, sf_dir)
    assert near.columns == docs.columns and every(near) == sorted(str(r) for r in rows if r[0] != 6)
    masked = stage["pii"](spark, docs, sf_dir)
    assert masked.columns == docs.columns and every(masked) == sorted(map(str, rows))
    mixed = stage["mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    want = plain_mixture(rows, corpus_pipeline.MIX_PERCENT, 17)
    key = lambda r: (str(r[0]), len(r[1] or ""))  # noqa: E731  rows that tie in id and length may be taken for each other
    assert set(every(mixed)) <= set(map(str, rows)) and sorted(map(key, mixed.collect())) == sorted(map(key, want))
    encoded = {(r["doc_id"], r["n_tokens"]) for r in stage["bpe"](spark, docs, sf_dir).collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    assert encoded == {(r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows}


def test_empty_tables(spark, sf_dir, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, no_docs, sf_dir)
        assert got.count() == 0 and (name == "bpe" or got.columns == no_docs.columns)
