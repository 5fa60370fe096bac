"""Ranked search, repeated passages and conversation repair against plain versions."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scriptloom.llm import dialogue, lexical, oracles, queries, suffixes
from test_oracles import compare


@pytest.mark.parametrize("name", ["op11_lexical", "op12_suffixes", "op13_dialogue"])
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries.queries()[name], oracles.oracle_sql()[name]) > 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_ranks(docs, items, k):
    held = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, terms in held for t in set(terms))
    out = []
    for item, text in items:
        scored = []
        for i, terms in held:
            m, tf = 25 + 75 * len(terms) * n_docs // max(n_terms, 1), Counter(terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(4096, 1 << 19, 4_000_000), (7, 40, 60), (50, 100, 700)])
def test_lists_equal_those_of_all_scores(spark, monkeypatch, sizes):
    for name, size in zip(("RANGE_DOCS", "RANGE_POSTINGS"), sizes):
        monkeypatch.setattr(lexical, name, size)
    rng = random.Random(sizes[0])
    words = ["a", "Bb", "ccc", "é", "字字", "d1", "x"] + [f"w{i}" for i in range(40)]
    said = lambda n: " ".join(rng.choice(words[: rng.choice([3, 47])]) + rng.choice(["", ",", "-", "É"]) for _ in range(n))
    docs = [(i, said(rng.choice([0, 1, 2, 5, 60]))) for i in range(150)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)] + [(7, "a Bb"), (7, "a Bb"), (None, "a bb"), (2000, None), (2001, ""), (2002, " ".join(["ccc"] * 30_000))]
    rng.shuffle(docs)
    items = [(i, said(rng.choice([1, 3, 10]))) for i in range(25)] + [(3, "ccc x"), (3, "ccc x"), (None, "a"), (90, None), (91, ""), (92, "nowhere"), (93, "a a a bb")]
    got = lexical.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=10, block_bytes=sizes[2])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(docs, items, 10)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_trees_of_any_fanout(fanout):
    import numpy as np

    rng = np.random.default_rng(fanout)
    for _ in range(60):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 12))
        table = rng.integers(0, 4, (5, n)) * (rng.random((5, n)) < 0.5)
        table[0, 0] = 1
        terms, places = np.nonzero(table)
        present, holding = np.unique(terms, return_counts=True)
        ids = sorted(rng.integers(0, n, n).tolist())
        asked = rng.permutation(5)[: rng.integers(1, 6)]
        query = lexical.Query(0, np.sort(asked), np.arange(1, len(asked) + 1))
        lexical.MaxTrees(ids, present, holding, places, table[terms, places], fanout).search(query, k)
        scores = query.times @ table[query.terms]
        assert query.best == sorted((-int(s), False, i) for s, i in zip(scores, ids) if s > 0)[:k]


def test_few_documents_are_scored_where_bounds_are_tight(spark):
    """One document of 4,096 holds the rare term, so the search opens a path of ranges and stops."""
    import numpy as np

    opened = []

    class Counted(lexical.MaxTrees):
        def bounds(self, level, parent, terms, times):
            opened.append(level)
            return super().bounds(level, parent, terms, times)

    places = np.concatenate([np.arange(4096), [77]])
    values = np.concatenate([np.full(4096, 5), [1000]])
    query = lexical.Query(1, np.array([0, 1]), np.array([1, 1]))
    Counted(list(range(4096)), np.array([0, 1]), np.array([4096, 1]), places, values).search(query, 1)
    assert query.best == [(-1005, False, 77)] and len(opened) < 10


def test_search_of_edge_cases(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one seven"), (2, None)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = lexical.rank_documents(edge_docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(rows, [(1, "one seven"), (2, None)], 10)
    assert lexical.rank_documents(no_docs, items).count() == lexical.rank_documents(edge_docs, items.limit(0)).count() == 0


def plain_removal(texts, length):
    """(bytes removed, runs, kept) of each text."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def test_suffixes_of_pieces():
    rng = random.Random(5)
    for _ in range(200):
        length, bodies = rng.choice([8, 9, 13, 16, 20]), []
        for _ in range(rng.randint(1, 12)):
            letters = rng.choice([b"ab", b"a", b"abcdefgh", b"\0\xc3\xa9"])
            b = bytes(rng.choice(letters) for _ in range(rng.randint(length, 60)))
            if bodies and rng.random() < 0.6:
                o = rng.choice(bodies)
                b = b[: rng.randint(0, len(b))] + o[rng.randint(0, len(o) - 1) :] + b
            bodies.append(b)
        count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        want = [[count[b[i : i + length]] > 1 for i in range(len(b) - length + 1)] for b in bodies]
        assert [x.tolist() for x in suffixes.repeated_windows(bodies, length)] == want


def odd_texts():
    rng = random.Random(3)
    said = lambda n: "".join(rng.choice("abcdé 字") for _ in range(n))
    common, shared = said(70), said(250)
    texts = [said(rng.choice([0, 30, 150, 400, 1500])) for _ in range(40)]
    texts += [said(90) + common + said(90) for _ in range(60)] + [said(40) + shared + said(rng.randint(0, 40)) for _ in range(6)]
    texts += ["a" * 300, "ab" * 200, "b" * 199, shared, shared, texts[3], None, "", "x" * 5000 + shared, (said(137) * 9)]
    near = said(900)
    texts += [near[:k] + "!" + near[k + 1 :] for k in (100, 300, 500, 850)]
    return texts


@pytest.mark.parametrize("stretch", [1, 64, 1 << 19])
def test_pieces_hold_every_window_once(stretch):
    texts = [(t or "").encode() for t in odd_texts()]
    for length in (200, 330):
        of, keys, pieces, places = suffixes.pieces_of(texts, length, stretch)
        held, key_of = [], defaultdict(set)
        for i, key, piece, place in zip(of.tolist(), keys.tolist(), pieces.tolist(), places.tolist()):
            for p in range(place >> 8, (place >> 8) + (place & 255) + 1):
                held.append((i, p))
                key_of[texts[i][p : p + length]].add(key)
        assert sorted(held) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - length + 1)]
        assert all(len(k) == 1 for k in key_of.values())


@pytest.mark.parametrize("most,limit,length", [(4096, 100_000, 200), (5, 0, 200), (2, 100_000, 60), (4096, 0, 330)])
def test_removal_equals_brute_force(spark, monkeypatch, most, limit, length):
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 20_000)
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = suffixes.without_repeats(docs, length=length, most=most, limit=limit).collect()
    raw = [(t or "").encode() for t in texts]
    want = [(i if i % 9 else None, len(t), *x) for i, (t, x) in enumerate(zip(raw, plain_removal(raw, length)))]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 1000


def test_least_hashes_do_not_depend_on_where_a_window_lies():
    import numpy as np

    rng = random.Random(1)
    window = bytes(rng.choice(b"ab") for _ in range(200))
    found = set()
    for k in range(50):
        body = bytes(rng.choice(b"abc") for _ in range(k * 7)) + window + b"c" * k
        hashes, least = suffixes.least_hashes(np.frombuffer(body, np.uint8), 200)
        found.add((int(least[k * 7]) - k * 7, int(hashes[least[k * 7]])))
    assert len(found) == 1


def test_removal_of_edge_cases(spark, edge_docs, no_docs):
    raw = [(r["doc_id"], (r["text"] or "").encode()) for r in edge_docs.collect()]
    got = suffixes.without_repeats(edge_docs).collect()
    want = [(i, len(t), *x) for (i, t), x in zip(raw, plain_removal([t for _, t in raw], 200))]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == sorted(want, key=str)
    assert suffixes.without_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        suffixes.without_repeats(no_docs, length=7)


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SAID = re.compile("[^\x20\x09-\x0d]")


def plain_repair(rows):
    """Uniform-cost search over rows in order, paths by (cost, labels)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        letters = SAID.findall(text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, labels, i, g, out = heapq.heappop(heap)
        if (i, g) in done:
            continue
        done.add((i, g))
        if i == len(rows) and g in (0, 3):
            break
        steps = [(role, STEP[g, role[0]]) for role in ("user", "assistant") if (g, role[0]) in STEP]
        for role, to in steps:
            heapq.heappush(heap, (cost + 2, labels + "I", i, to, out + (role + ":",)))
        if i < len(rows):
            _, own, text = rows[i]
            more = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, labels + "D", i + 1, g, out))
            if faults[i] not in ("blank", "duplicate"):
                if (g, own[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, STEP[g, own[:1]], out + (own + ":" + text,)))
                for role, to in steps:
                    heapq.heappush(heap, (cost + 2 + more, labels + "R", i + 1, to, out + (role + ":" + text,)))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, labels, out


def odd_conversations():
    rng, rows = random.Random(4), []
    for conv in [*range(60), None]:
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", "u", "tool", "", None]), rng.choice(["Hi.", "Hi.", "yes", "", " \t", "ok! ", None, "é?"])))
    for k in range(3000):  # one conversation with most rows
        rows.append((99, k // 3 * 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "again.", "", "yes"])))
    return rows


@pytest.mark.parametrize("rows_a_table,held,limit", [(256, 4_000_000, 100_000), (3, 40, 0)])
def test_repair_equals_plain_search(spark, rows_a_table, held, limit):
    rows = odd_conversations()
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: plain_repair(r) for c, r in by.items()}
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(7)
    audits = dialogue.audit(df, limit=limit, rows_a_table=rows_a_table, held_chars=held)
    got = {r["conv_id"]: tuple(r)[1:] for r in audits.collect()}
    assert got == {c: (*w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest()) for c, w in want.items()}
    turns = defaultdict(list)
    for r in dialogue.repaired_turns(df, audits).orderBy("place").collect():
        turns[r["conv_id"]].append(r["role"] + ":" + r["text"])
    assert {c: tuple(t) for c, t in turns.items()} == {c: w[-1] for c, w in want.items() if w[-1]}


def test_damage_and_conversations_without_rows(spark):
    import zlib

    rows = [(c, t, r, f"Said {c}, {t}. Yes!") for c in [*range(40), None] for t, r in ((0, "user"), (1, None), (None, "user"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if code == 4 else r or " ", "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x)
        want += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(str, map(tuple, dialogue.damage(df).collect()))) == sorted(map(str, want))
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (one,) = dialogue.audit_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)).collect()
    assert tuple(one) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dialogue.audit_damaged(df.limit(0)).count() == 0
    assert dialogue.audit(df.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")).schema["conv_id"].dataType.simpleString() == "string"
