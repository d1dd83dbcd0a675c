"""Structure strings against a plain reader, and known graphs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.operators import retrieval as RT
from pairloom.operators import structures as ST


def graphs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, smiles string")
    return {r["k"]: r["graph"] for r in ST.with_graph(df).collect()}


KNOWN = {  # text: (symbols with hydrogens and charges, bonds)
    "CCO": (["C3", "C2", "O1"], [(0, 1, 1), (1, 2, 1)]),
    "CC(=O)O": (["C3", "C0", "O0", "O1"], [(0, 1, 1), (1, 2, 2), (1, 3, 1)]),
    "c1ccccc1": (["C1"] * 6, [(0, 1, 1.5), (1, 2, 1.5), (2, 3, 1.5), (3, 4, 1.5), (4, 5, 1.5), (0, 5, 1.5)]),
    "C1CC1C": (["C2", "C2", "C1", "C3"], [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1)]),
    "[NH4+].[Cl-]": (["N4+1", "Cl0-1"], []),
    "[13CH3][O--]": (["C3", "O0-2"], [(0, 1, 1)]),
    "C=1CCC=1": (["C1", "C2", "C2", "C1"], [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 2)]),
    "F/C=C\\F": (["F0", "C1", "C1", "F0"], [(0, 1, 1), (1, 2, 2), (2, 3, 1)]),
    "C%12CC%12": (["C2"] * 3, [(0, 1, 1), (1, 2, 1), (0, 2, 1)]),
    "N[C@@H](C)C(=O)O": (["N2", "C1", "C3", "C0", "O0", "O1"], [(0, 1, 1), (1, 2, 1), (1, 3, 1), (3, 4, 2), (3, 5, 1)]),
    "c1cc[nH]c1": (["C1", "C1", "C1", "N1", "C1"], [(0, 1, 1.5), (1, 2, 1.5), (2, 3, 1.5), (3, 4, 1.5), (0, 4, 1.5)]),
    "CS(=O)(=O)C": (["C3", "S0", "O0", "O0", "C3"], [(0, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 1)]),
    " C#N ": (["C1", "N0"], [(0, 1, 3)]),
    "*C": (["*0", "C3"], [(0, 1, 1)]),
}
BAD = ["", None, " ", "C(", "C)", "C1CC", "C=", "=C", "C==C", "C()C", "(C)C", "C((C))C", "[C", "C]", "[Xx]", "[]", "C11", "C1C1", "C=1CC#1", "C..C", ".C", "C.", "C(=)C", "1CC1", "Cx", "C C", "[H", "C(.C)", "C%1C", "[CH3+x]"]


def test_known_structures(spark):
    got = graphs(spark, list(KNOWN))
    for k, (text, (atoms, bonds)) in enumerate(KNOWN.items()):
        g = got[k]
        assert g["valid"], text
        assert [f"{a['symbol']}{a['hydrogens']}" + (f"{a['charge']:+d}" if a["charge"] else "") for a in g["atoms"]] == atoms, text
        assert sorted((b["a"], b["b"], b["order"]) for b in g["bonds"]) == sorted(bonds), text


def test_texts_outside_the_grammar(spark):
    got = graphs(spark, BAD)
    assert [BAD[k] for k, g in got.items() if g["valid"]] == []
    assert all(g["atoms"] == [] and g["bonds"] == [] for g in got.values())


def test_rings_and_bonds_between_them(spark):
    biphenyl, naphthalene, spiro = graphs(spark, ["c1ccccc1c1ccccc1", "c1ccc2ccccc2c1", "CC1CC12CCC2C"]).values()
    assert [(b["a"], b["b"], b["order"]) for b in biphenyl["bonds"] if not b["in_ring"]] == [(5, 6, 1.0)]
    assert all(b["in_ring"] for b in naphthalene["bonds"]) and [a["hydrogens"] for a in naphthalene["atoms"]].count(0) == 2
    assert [a["in_ring"] for a in spiro["atoms"]] == [False] + [True] * 6 + [False]


def plain(text):
    """(atoms, bonds): a stack and a dict of open rings."""
    atoms, bonds, stack, rings, at, want = [], [], [], {}, None, ""
    for x in re.findall(ST.TOKEN, text):
        if x == "(":
            stack.append(at)
        elif x == ")":
            at = stack.pop()
        elif x == ".":
            at = None
        elif x[0] in "%0123456789":
            if x in rings:
                other, kind = rings.pop(x)
                bonds.append((other, at, want or kind))
            else:
                rings[x] = (at, want)
            want = ""
        elif x in ST.ORDERS:
            want = x
        else:
            if at is not None:
                bonds.append((at, len(atoms), want))
            atoms.append(x)
            at, want = len(atoms) - 1, ""
    return atoms, bonds


def in_ring(bonds, k):
    a, b, _ = bonds[k]
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for i, (p, q, _) in enumerate(bonds):
            if i != k and x in (p, q) and (y := q if x == p else p) not in seen:
                seen.add(y)
                todo.append(y)
    return b in seen


PARTS = ["C", "CC(=O)", "c1ccccc1", "N", "O", "C(F)(F)", "[NH2+]", "S(=O)(=O)", "C2CC(C1CC1)CC2", "c1cnc(Cl)nc1", "/C=C/", "C%11OC(C)C%11", "[13C@H](Br)", "C(C(C)(N)O)", "c1cc2ccccc2cc1"]


def made(n, seed):
    g = random.Random(seed)
    return [g.choice(["C", "N", "c1ccccc1"]) + "".join(g.choice(PARTS) for _ in range(g.randint(1, 7))) + g.choice(["", "C", ".[Na+]"]) for _ in range(n)]


def test_against_the_plain_reader(spark):
    texts = [t for t in made(80, 1) if "/." not in t and "//" not in t and not t.endswith("/")]
    for k, g in graphs(spark, texts).items():
        atoms, bonds = plain(texts[k])
        assert g["valid"] and len(g["atoms"]) == len(atoms), texts[k]
        assert [(b["a"], b["b"]) for b in g["bonds"]] == [(a, b) for a, b, _ in bonds]
        assert [b["in_ring"] for b in g["bonds"]] == [in_ring(bonds, i) for i in range(len(bonds))], texts[k]
        assert [a["degree"] for a in g["atoms"]] == [sum(i in b[:2] for b in bonds) for i in range(len(atoms))]


def plain_bits(g, radius, bits):
    def h(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    ids = [h(a["symbol"], a["charge"], a["degree"], a["hydrogens"], a["isotope"] or 0, int(a["in_ring"]), int(a["aromatic"])) for a in g["atoms"]]
    out = set(ids)
    for k in range(1, radius + 1):
        near = [sorted((int(b["order"] * 2), ids[b["b"] if b["a"] == i else b["a"]]) for b in g["bonds"] if i in (b["a"], b["b"])) for i in range(len(ids))]
        ids = [h(k, ids[i], ",".join(f"{o}-{n}" for o, n in near[i])) for i in range(len(ids))]
        out |= set(ids)
    return sorted({x % bits for x in out})


def test_circular_bits(spark):
    texts = [*made(25, 2), "OCC", "CCO", "C(O)C", "C(", None]  # some of the made ones are not valid
    df = ST.circular_bits(ST.with_graph(spark.createDataFrame(list(enumerate(texts)), "k int, smiles string")))
    got = {r["k"]: r for r in df.collect()}
    for k, r in got.items():
        assert r["bits"] == plain_bits(r["graph"], 2, 1024)
    assert got[25]["bits"] == got[26]["bits"] == got[27]["bits"] != [] and got[28]["bits"] == got[29]["bits"] == []


def test_atom_features_and_rows(spark):
    df = ST.with_graph(spark.createDataFrame([(1, "C#Cc1ccccc1[Na]"), (2, "[U]"), (3, "x")], "k int, smiles string"))
    v = {r["k"]: r["v"] for r in df.select("k", ST.atom_features(F.col("graph")).alias("v")).collect()}
    assert v[3] == [] and all(len(x) == 55 for x in v[1]) and v[2][0][43] == 1.0
    assert [x[48:53].index(1.0) for x in v[1]] == [0, 0, 1, 1, 1, 1, 1, 1, 2] and v[1][2][53] == 1.0 and v[1][0][44] == pytest.approx(0.1)
    assert ST.atom_rows(df, "k").count() == 10 and ST.bond_rows(df, "k").count() == 18


def test_similarity_map_against_plain_loops(spark):
    g = random.Random(6)
    texts = {f"d{i}": t for i, t in enumerate(made(14, 3))} | {"bad": "C(", "none": None}
    nodes = [*texts, "unknown"]
    pairs = sorted({tuple(g.sample(sorted(nodes), 2)) for _ in range(30)})
    pool, queries = pairs[:12], pairs[8:] + pairs[8:10]
    rows = spark.createDataFrame([*texts.items(), (None, "C")], "node string, smiles string")
    out = RT.similarity_map(spark.createDataFrame(queries, "qa string, qb string"), spark.createDataFrame(pool, "ra string, rb string"), rows, 4, 7).collect()
    graphs_ = {r["node"]: r["graph"] for r in ST.with_graph(rows).collect()}
    bits = {n: set(plain_bits(graphs_[n], 2, 1024)) for n in texts}
    sim = lambda u, v: len(bits[u] & bits[v]) / len(bits[u] | bits[v]) if bits[u] | bits[v] else 0.0
    for qa, qb in set(queries):
        mine = sorted((r["place"], r["ra"], r["rb"], r["score"], r["note"]) for r in out if (r["qa"], r["qb"]) == (qa, qb))
        assert [m[0] for m in mine] == [1, 2, 3, 4]
        want = []
        if {qa, qb} <= set(texts):
            apart = [(a, b) for a, b in pool if not {a, b} & {qa, qb} and {a, b} <= set(texts)]
            want = sorted((-max((sim(qa, a) + sim(qb, b)) / 2, (sim(qa, b) + sim(qb, a)) / 2), a, b) for a, b in apart)[:4]
        assert [(m[1], m[2], pytest.approx(m[3])) for m in mine if m[4] == ""] == [(a, b, -s) for s, a, b in want]
        assert all(m[3] == 0.0001 and (m[1], m[2]) in pool for m in mine if m[4] == "padding")
    with pytest.raises(ValueError):
        RT.similarity_map(spark.createDataFrame(queries, "qa string, qb string"), spark.createDataFrame([], "ra string, rb string"), rows, 2, 7)
