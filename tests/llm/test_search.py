"""Ranked search against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import search as se

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {65 + i: 97 + i for i in range(26)}
DOCS = "doc_id long, text string, score string, rank string, term string"


def plain(docs, items, k=50):
    tf = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs if i is not None]
    n, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(SMALL)))
    out = []
    for item, terms in asked.items():
        rows = []
        for d, c in tf:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                rows.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], DOCS)
    return sorted(tuple(r) for r in se.search(d, spark.createDataFrame(items, "item_id long, text string"), **how).collect())


def corpus(n, seed):
    g = random.Random(seed)
    words = [f"w{int(g.paretovariate(0.6))}" for _ in range(3000)] + ["Éa", "ñ9", "THE"]
    docs = [(g.randint(-5000, 5000), g.choice([" ", "-", "\n"]).join(g.choice(words) for _ in range(g.randint(0, 40)))) for _ in range(n)]
    return docs, [(i, " ".join(g.choice(words) for _ in range(g.randint(0, 12)))) for i in range(25)]


@pytest.mark.parametrize("k", [3, 50])
def test_against_plain_loops(spark, k):
    docs, items = corpus(400, 1)
    docs += [(6000 + i, docs[7][1]) for i in range(120)]  # a large group of equal scores, cut by doc_id
    items += [(90, docs[7][1]), (91, docs[7][1][:30]), (91, "w1 w2")]
    assert found(spark, docs, items, k=k) == plain(docs, items, k)


def test_small_shards_blocks_and_the_index_of_all_terms(spark, monkeypatch):
    docs, items = corpus(150, 2)
    for name, value in (("SHARD_DOCS", 7), ("SHARD_POSTINGS", 60), ("VOCABULARY", 3), ("BLOCK_TERMS", 40), ("PIECE", 5)):
        monkeypatch.setattr(se, name, value)
    assert found(spark, docs, items, k=5) == plain(docs, items, 5)


def test_odd_rows(spark):
    long = "alpha beta " * 200_000
    docs = [(1, None), (2, ""), (3, long), (4, "Beta gamma"), (4, "beta GAMMA"), (None, "beta"), (5, " \t-- "), (6, "\U0001f600 beta\x00gamma")]
    items = [(1, None), (2, ""), (3, "beta alpha"), (None, "beta"), (4, "nowhere"), (5, "\U0001f600"), (6, "gamma gamma GAMMA")]
    got = found(spark, docs, items)
    assert got == plain(docs, items) and {r[0] for r in got} == {3, 5, 6}
    assert [r[2] for r in got if r[0] == 6].count(4) == 2
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, "")], items) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=40))
def test_packed_numbers_come_back(xs):
    assert se.unpacked(se.packed(np.array(xs, np.uint64))).tolist() == xs


def test_a_shard_comes_back_sorted():
    shard, g = se.Shard(), random.Random(3)
    docs = [(g.randint(-(2**62), 2**62), Counter(g.choice("abc") for _ in range(g.randint(1, 300)))) for _ in range(60)]
    for d, c in docs:
        shard.add(d, c, None)
    rows = {t: (n, total, p) for t, n, total, p in shard.rows()}
    ids, lengths = se.documents_of(rows[b""][2], rows[b""][0])
    assert list(zip(ids.tolist(), lengths.tolist())) == sorted((d, c.total()) for d, c in docs)
    for t in "abc":
        at, tf = se.postings_of(rows[t][2])
        assert [(int(ids[a]), f) for a, f in zip(at, tf.tolist())] == sorted((d, c[t]) for d, c in docs if c[t])
        assert rows[t][:2] == (len(at), int(tf.sum()))
