"""Mentions of names against the plain loop of all names over all texts."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.operators import audit as AU
from pairloom.operators import mentions as M


def plain(rows, names):
    """One pattern for each name, as (key, text, start, end, other), in order."""
    out = []
    own = {}
    for k, n in names:
        own.setdefault(k, []).append(n.lower())
    for key, text in rows:
        for other, name in sorted(set(names)):
            n = name.strip()
            if other != key and len(n) >= 4 and n.lower() not in own.get(key, []):
                out += [(key, m[0], m.start(), m.end(), other) for m in re.finditer(r"\b" + re.escape(n) + r"\b", text or "", re.I)]
    return sorted(out, key=str)


def found(rows, names):
    got = M.Names(names).mentions([k for k, _ in rows], [t or "" for _, t in rows]) if names else [[] for _ in rows]
    return sorted(((k, *m) for (k, _), ms in zip(rows, got) for m in ms), key=str)


def case(seed, n=60):
    g = random.Random(seed)
    words = ["acid", "Acid", "acidic", "beta", "beta-2", "é", "Éclair", "(S)-ol", "x y", "ſalt", "SALT", "naïve", "ab ab", "漢字", "_", "12", "ol"]
    text = lambda low, high: "".join(g.choice(words) + g.choice([" ", " ", "-", ", ", ""]) for _ in range(g.randint(low, high)))
    names = [(f"k{g.randint(0, 30)}", g.choice(["", " "]) + text(1, 3) + g.choice(["", "\t"])) for _ in range(40)]
    return [(f"k{g.randint(0, 40)}", text(0, 80)) for _ in range(n)], [(k, n) for k, n in names if len(n.strip()) >= 4]


@pytest.mark.parametrize("seed", range(6))
def test_against_the_plain_loop(seed, monkeypatch):
    rows, names = case(seed)
    for block, lane, dense in ((1 << 21, 256, 8192), (300, 3, 1), (500, 40, 17)):
        monkeypatch.setattr(M, "BLOCK", block)
        monkeypatch.setattr(M, "LANE", lane)
        monkeypatch.setattr(M, "DENSE", dense)
        assert found(rows, names) == plain(rows, names)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", min_size=4, max_size=9), max_size=6), st.lists(st.text("ab ", max_size=40), max_size=4))
def test_names_that_overlap(names, texts):
    told = [(f"n{i}", n) for i, n in enumerate(names) if len(n.strip()) >= 4]
    rows = [(f"t{i}", t) for i, t in enumerate(texts)]
    assert found(rows, told) == plain(rows, told)


def test_automaton_finds_every_place_in_long_texts():
    names = [b"aa", b"aaa", b"ba", b"a" * 40]
    text = np.frombuffer(b"a" * 5000 + b"b" + b"a" * 5000, np.uint8)
    number, start, end = M.Automaton(names).found(text)
    body = text.tobytes()
    want = {(n, i, i + len(name)) for n, name in enumerate(names) for i in range(len(body)) if body.startswith(name, i)}
    assert set(zip(number.tolist(), start.tolist(), end.tolist())) == want and len(number) == len(want)


def test_in_spark_with_many_tables_and_odd_rows(spark):
    rows, names = case(9)
    rows += [(None, "Some acid beta here"), ("z", None), ("z", ""), ("z", "beta " * 50_000)]
    texts = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "drug_id string, text string, start string, others string")
    told = spark.createDataFrame([*names, (None, "acid"), ("n", None), ("short", "ol"), *names[:5]], "drug_id string, name string")
    want = plain(rows, names)
    for size in (1 << 22, 60):
        out = M.with_mentions(texts, told, table_bytes=size)
        assert out.columns == ["drug_id", "text", "start", "others"]
        got = [(r["drug_id"], m["text"], m["start"], m["end"], m["other"]) for r in out.collect() for m in r["others"]]
        assert sorted(got, key=str) == want
    assert all(r["others"] == [] for r in M.with_mentions(texts, told.limit(0)).collect())
    assert M.with_mentions(texts.limit(0), told).collect() == []


def test_audit_holds_names_of_others_last(spark):
    rows = spark.createDataFrame([("a", "Aspirin with WARFARIN and CYP3A4", ["cyp3a4"]), ("b", "warfarin", None)], "drug_id string, text string, own array<string>")
    names = spark.createDataFrame([("a", "aspirin"), ("b", "Warfarin"), ("c", "Aspirin")], "drug_id string, name string")
    got = {r["drug_id"]: [(m["category"], m["text"], m["start"]) for m in r["mentions"]] for r in AU.audit_descriptions(rows, names=names).collect()}
    assert got == {"a": [("short_form", "CYP3A4", 26), ("own_kg", "CYP3A4", 26), ("other_drug", "WARFARIN", 13)], "b": []}


def test_what_a_rule_requires_is_in_every_match():
    said = "cyp3a4 ugt1a1 mao-b maob monoamine oxidase p-glycoprotein pglycoprotein p-gp oatp1b1 oat1 oct2 mate1 mrp2 ntcp bsep hmg-coa reductase 5-ht2a dopamine d2 receptor d2 receptor "
    said += "beta-1 receptor beta2 receptor alpha1 receptor muscarinic m1 gabaa receptor nmda receptor cox-2 alpha-1-acid glycoprotein drug-drug interaction drug interactions "
    said += "interactions with many drugs interact with agents has numerous interactions prone to interaction be aware of interactions potential interactions known drug interaction coadministrated"
    for p in (*AU.ENTITY_PATTERNS, *AU.PHRASE_PATTERNS):
        need = AU.required(p)
        assert len(need) >= 2
        assert all(need in m[0] for m in re.finditer(p, said))
