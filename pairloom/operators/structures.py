"""Structure strings as graphs of atoms and bonds, and circular fingerprints, in native expressions.

A string is cut into tokens; a machine with a stack for branches and slots for open ring bonds runs over
them in one ``aggregate``.  Bonds between atoms that follow each other make a tree in which a parent comes
first, so the bonds that lie in rings are those on the tree's paths between the ends of each ring closure.
Everything happens within its row: nothing is shuffled, and no Python runs.

The grammar is that of the published line notation.  What it allows is valid here, whatever a chemist would say of
its valences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash32

# Fixed values -------------------------------------------------------------------------------
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg "
    "Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
AROMATIC = "b c n o p s se as te".split()
#: Usual valences of atoms that may stand without brackets.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
ORDERS = {"-": 1.0, "/": 1.0, "\\": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "~": 1.0}
#: Symbols of the feature vector, the last for all others.
FEATURE_SYMBOLS = (
    "C N O S F Si P Cl Br Mg Na Ca Fe As Al I B V K Tl Yb Sb Sn Ag Pd Co Se Ti Zn H Li Ge Cu Au Ni Cd In Mn Zr Cr Pt Hg Pb Unknown"
).split()
# ---------------------------------------------------------------------------------------------

_SYMBOL = "|".join(sorted([*ELEMENTS, *AROMATIC], key=lambda s: (-len(s), s)))
BRACKET = rf"^\[(\d*)({_SYMBOL}|\*)(@(?:@|TH[12]|AL[12]|SP[123]|TB\d\d?|OH\d\d?)?)?(H\d?)?(\+\d\d?|-\d\d?|\++|-+)?(:\d+)?\]$"
TOKEN = r"\[[^\[\]]*\]|Br|Cl|[BCNOPSFIbcnops*]|[-=#$:/\\~]|%\d\d|\d|[().]"

_RING, _BOND = "array<struct<num:int,atom:int,kind:string>>", "array<struct<a:int,b:int,kind:string,closes:boolean>>"
ATOM = "array<struct<symbol:string,aromatic:boolean,charge:int,isotope:int,hydrogens:int,degree:int,in_ring:boolean>>"


def _text(pattern: str, x: Column, group: int) -> Column:
    return F.regexp_extract(x, pattern, group)


#: Kinds of tokens.
ATOM_TOKEN, OPENS, CLOSES, DOT, RING, BOND = range(6)


def _token(x: Column) -> Column:
    """A token with its kind and, for ring bonds, its number."""
    ring = x.rlike(r"^[%\d]")
    kind = F.when(x.rlike(r"^[\[A-Za-z*]"), ATOM_TOKEN).when(x == "(", OPENS).when(x == ")", CLOSES).when(x == ".", DOT).when(ring, RING).otherwise(BOND)
    num = F.when(ring, F.replace(x, F.lit("%"), F.lit("")).cast("int")).otherwise(-1)
    return F.struct(x.alias("x"), kind.alias("kind"), num.alias("num"))


def _start() -> Column:
    none = F.expr("cast(array() as array<int>)")
    return F.struct(
        F.lit(0).alias("n"), F.lit(-1).alias("at"), none.alias("stack"), F.lit("").alias("want"), F.expr(f"cast(array() as {_RING})").alias("rings"),
        F.expr(f"cast(array() as {_BOND})").alias("bonds"), none.alias("parents"), F.lit(False).alias("bad"), F.lit(-1).alias("last"),
    )


def _step(m: Column, token: Column) -> Column:
    """The machine after one token.  ``at``: the atom that the next one joins (-1: none); ``want``: a bond told so far;
    ``parents``: the atom that each atom joined."""
    open_ring = F.when(token["kind"] == RING, F.get(F.filter(m["rings"], lambda r: r["num"] == token["num"]), F.lit(0)))
    return _let(open_ring, lambda ring: _after(m, token, ring))


def _after(m: Column, token: Column, open_ring: Column) -> Column:
    x, kind = token["x"], token["kind"]
    atom, opens, closes, dot, ring, bond = (kind == k for k in (ATOM_TOKEN, OPENS, CLOSES, DOT, RING, BOND))
    ends = ring & open_ring.isNotNull()
    said = F.when(m["want"] != "", m["want"]).otherwise(open_ring["kind"])
    top = F.size(m["stack"]) - 1

    def one(a: Column, b: Column, what: Column, ring_bond: bool) -> Column:
        return F.array(F.struct(a.alias("a"), b.alias("b"), what.alias("kind"), F.lit(ring_bond).alias("closes")))

    mine = F.struct(token["num"].alias("num"), m["at"].alias("atom"), m["want"].alias("kind"))
    straight = F.lit("/\\")
    clash = (
        (m["want"] != "") & (open_ring["kind"] != "") & (m["want"] != open_ring["kind"])
        & ~(F.contains(straight, m["want"]) & F.contains(straight, open_ring["kind"]))
    )
    ends_of = lambda b, u, v: ((b["a"] == u) & (b["b"] == v)) | ((b["b"] == u) & (b["a"] == v))
    again = F.exists(m["bonds"], lambda b: ends_of(b, open_ring["atom"], m["at"]))
    lone, opened = m["at"] < 0, m["last"] == OPENS
    wrong = (
        F.when(atom, F.lit(False))
        .when(bond, lone | (m["want"] != ""))
        .when(opens, lone | (m["want"] != "") | opened)
        .when(closes, (top < 0) | (m["want"] != "") | opened | (m["last"] == DOT))
        .when(dot, lone | (m["want"] != "") | opened)
        .when(ends, lone | opened | (open_ring["atom"] == m["at"]) | clash | again)
        .otherwise(lone | opened)
    )
    return F.struct(
        F.when(atom, m["n"] + 1).otherwise(m["n"]).alias("n"),
        F.when(atom, m["n"]).when(closes, F.coalesce(F.get(m["stack"], top), F.lit(-1))).when(dot, F.lit(-1)).otherwise(m["at"]).alias("at"),
        F.when(opens, F.concat(m["stack"], F.array(m["at"])))
        .when(closes, F.slice(m["stack"], F.lit(1), F.greatest(top, F.lit(0))))
        .otherwise(m["stack"])
        .alias("stack"),
        F.when(bond, x).when(atom | ring, F.lit("")).otherwise(m["want"]).alias("want"),
        F.when(ends, F.filter(m["rings"], lambda r: r["num"] != token["num"])).when(ring, F.concat(m["rings"], F.array(mine))).otherwise(m["rings"]).alias("rings"),
        F.when(atom & (m["at"] >= 0), F.concat(m["bonds"], one(m["at"], m["n"], m["want"], False)))
        .when(ends, F.concat(m["bonds"], one(open_ring["atom"], m["at"], said, True)))
        .otherwise(m["bonds"])
        .alias("bonds"),
        F.when(atom, F.concat(m["parents"], F.array(m["at"]))).otherwise(m["parents"]).alias("parents"),
        (m["bad"] | F.coalesce(wrong, F.lit(False))).alias("bad"),
        kind.alias("last"),
    )


def _told_atom(x: Column) -> Column:
    """What the token of an atom says; its hydrogens only if it has brackets."""
    boxed = x.startswith("[")
    symbol = F.when(boxed, _text(BRACKET, x, 2)).otherwise(x)
    h, q = _text(BRACKET, x, 4), _text(BRACKET, x, 5)
    size = F.when(q.rlike(r"\d"), _text(r"(\d+)", q, 1).cast("int")).otherwise(F.length(q))
    return F.struct(
        F.initcap(symbol).alias("symbol"), symbol.rlike("^[a-z]").alias("aromatic"), F.when(boxed, F.when(q.startswith("-"), -size).otherwise(size)).otherwise(F.lit(0)).alias("charge"),
        F.when(boxed & (_text(BRACKET, x, 1) != ""), _text(BRACKET, x, 1).try_cast("int")).alias("isotope"),
        F.when(~boxed, F.lit(None).cast("int")).when(h == "", F.lit(0)).when(h == "H", F.lit(1)).otherwise(F.substring(h, 2, 1).try_cast("int")).alias("h"),
    )


def _tree_of_ring(bond: Column, parents: Column) -> Column:
    """Atoms whose bond to their parent lies on the path between the ends of a ring closure: both climb, the later one first."""
    begin = F.struct(bond["a"].alias("u"), bond["b"].alias("v"), F.expr("cast(array() as array<int>)").alias("on"))

    def climb(s: Column, i: Column) -> Column:
        up = F.get(parents, i)
        met = (s["u"] != s["v"]) & ((s["u"] == i) | (s["v"] == i)) & (up >= 0)
        moved = F.struct(
            F.when(s["u"] == i, up).otherwise(s["u"]).alias("u"), F.when(s["v"] == i, up).otherwise(s["v"]).alias("v"), F.concat(s["on"], F.array(i)).alias("on")
        )
        return F.when(met, moved).otherwise(s)

    return F.aggregate(F.sequence(F.greatest(bond["a"], bond["b"]), F.lit(0)), begin, climb, lambda s: s["on"])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: the optimizer may not copy it into inner functions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def graph_of(text: Column) -> Column:
    """(valid, atoms, bonds) of a structure string, atoms numbered from 0 in their order, bonds (a, b, order, in_ring).

    Blanks around the text do not count.  Null, empty and ungrammatical texts are not valid and have empty arrays.
    Order is 1.5 for aromatic bonds: told by ':' or, if nothing is told, between aromatic atoms within a ring.  Atoms
    without brackets get the hydrogens that fill their least usual valence.
    """
    none = F.struct(
        F.lit(False).alias("valid"), F.expr(f"cast(array() as {ATOM})").alias("atoms"), F.expr("cast(array() as array<struct<a:int,b:int,order:double,in_ring:boolean>>)").alias("bonds")
    )

    def run(s: Column) -> Column:
        tokens = F.transform(s["x"], _token)
        return _let(
            tokens,
            lambda k: F.struct(
                s["t"].alias("t"), s["x"].alias("x"), F.aggregate(k, _start(), _step).alias("m"),
                F.transform(F.filter(k, lambda x: x["kind"] == ATOM_TOKEN), lambda x: x["x"]).alias("a"),
            ),
        )

    def judged(s: Column) -> Column:
        m = s["m"]
        fine = (
            (F.array_join(s["x"], "") == s["t"]) & (m["n"] > 0) & ~m["bad"] & (F.size(m["stack"]) == 0) & (F.size(m["rings"]) == 0) & (m["want"] == "") & (m["last"] != DOT)
            & ~F.exists(s["a"], lambda x: x.startswith("[") & ~x.rlike(BRACKET))
        )
        told = F.struct(F.transform(s["a"], _told_atom).alias("told"), m["bonds"].alias("bonds"), _on_tree(m["bonds"], m["parents"]).alias("on"))
        return F.when(fine, _let(told, _bound)).otherwise(none)

    t = F.trim(F.coalesce(text, F.lit("")))
    return _let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("x")), lambda s: _let(run(s), judged))


def _on_tree(bonds: Column, parents: Column) -> Column:
    paths = F.transform(F.filter(bonds, lambda b: b["closes"]), lambda b: _tree_of_ring(b, parents))
    return F.array_distinct(F.flatten(paths))


def _bound(s: Column) -> Column:
    """The graph of told atoms, bonds, and atoms whose bond to their parent is in a ring."""

    def bond(b: Column) -> Column:
        ring = b["closes"] | F.array_contains(s["on"], b["b"])
        soft = ring & F.get(s["told"], b["a"])["aromatic"] & F.get(s["told"], b["b"])["aromatic"]
        order = F.when(b["kind"] == "", F.when(soft, F.lit(1.5)).otherwise(F.lit(1.0)))
        for kind, size in ORDERS.items():
            order = order.when(b["kind"] == kind, F.lit(size))
        return F.struct(b["a"].alias("a"), b["b"].alias("b"), order.alias("order"), ring.alias("in_ring"))

    def atom(x: Column, mine: Column) -> Column:
        used = F.aggregate(mine, F.lit(0.0), lambda total, b: total + b["order"])
        return _let(used, lambda u: _filled(x, mine, u))

    def whole(bonds: Column) -> Column:
        atoms = F.transform(s["told"], lambda x, i: _let(F.filter(bonds, lambda b: (b["a"] == i) | (b["b"] == i)), lambda mine: atom(x, mine)))
        return F.struct(F.lit(True).alias("valid"), atoms.alias("atoms"), bonds.alias("bonds"))

    return _let(F.transform(s["bonds"], bond), whole)


def _filled(x: Column, mine: Column, used: Column) -> Column:
    fill = F.lit(0)
    for symbol, valences in VALENCES.items():
        spare = F.lit(0)
        for v in reversed(valences):
            spare = F.when(used <= v, F.floor(v - used).cast("int")).otherwise(spare)
        soft = F.greatest(F.floor(valences[0] - used).cast("int"), F.lit(0))
        fill = F.when(x["symbol"] == symbol, F.when(x["aromatic"], soft).otherwise(spare)).otherwise(fill)
    return F.struct(
        x["symbol"].alias("symbol"), x["aromatic"].alias("aromatic"), x["charge"].alias("charge"), x["isotope"].alias("isotope"), F.coalesce(x["h"], fill).alias("hydrogens"),
        F.size(mine).alias("degree"), F.exists(mine, lambda b: b["in_ring"]).alias("in_ring"),
    )


def with_graph(rows: DataFrame, text: str = "smiles", out: str = "graph") -> DataFrame:
    """``rows`` with ``out``: the graph of each text, see ``graph_of``."""
    return rows.withColumn(out, graph_of(F.col(text)))


def atom_rows(graphs: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """(key, idx, symbol, aromatic, charge, isotope, hydrogens, degree, in_ring) of every atom."""
    return graphs.select(key, F.posexplode(F.col(graph)["atoms"]).alias("idx", "x")).select(key, "idx", "x.*")


def bond_rows(graphs: DataFrame, key: str, graph: str = "graph") -> DataFrame:
    """(key, src, dst, order, in_ring): each bond in both directions."""

    def one(b: Column, src: str, dst: str) -> Column:
        return F.struct(b[src].alias("src"), b[dst].alias("dst"), b["order"].alias("order"), b["in_ring"].alias("in_ring"))

    both = F.flatten(F.transform(F.col(graph)["bonds"], lambda b: F.array(one(b, "a", "b"), one(b, "b", "a"))))
    return graphs.select(key, F.explode(both).alias("x")).select(key, "x.*")


def atom_features(graph: Column) -> Column:
    """A vector for each atom: symbol one-hot (the last for others), degree / 10, filled hydrogens, charge, unpaired
    electrons (0), hybridisation one-hot (sp, sp2, sp3, sp3d, sp3d2), aromatic, hydrogens.

    Hybridisation follows the bonds: six or more neighbours and hydrogens, or five, for the last two, a triple or two
    double bonds for sp, a double or aromatic one for sp2, else sp3.
    """
    f = lambda c: c.cast("float")

    def vector(x: Column, mine: Column) -> Column:
        doubles = F.size(F.filter(mine, lambda b: b["order"] == 2.0))
        sp = F.exists(mine, lambda b: b["order"] >= 3.0) | (doubles >= 2)
        sp2 = (doubles == 1) | F.exists(mine, lambda b: b["order"] == 1.5)
        around = x["degree"] + x["hydrogens"]
        kind = F.when(around >= 6, 4).when(around == 5, 3).when(sp & (x["degree"] <= 2), 0).when(sp | sp2, 1).otherwise(2)
        numbers = F.array(f(x["degree"] / 10), f(x["hydrogens"]), f(x["charge"]), f(F.lit(0)))
        known = F.array_position(F.array(*map(F.lit, FEATURE_SYMBOLS)), x["symbol"]).cast("int")
        place = F.when(known > 0, known - 1).otherwise(len(FEATURE_SYMBOLS) - 1)
        return F.concat(_one_hot(place, len(FEATURE_SYMBOLS)), numbers, _one_hot(kind, 5), F.array(f(x["aromatic"]), f(x["hydrogens"])))

    def of_graph(g: Column) -> Column:
        return F.transform(g["atoms"], lambda x, i: _let(F.filter(g["bonds"], lambda b: (b["a"] == i) | (b["b"] == i)), lambda mine: vector(x, mine)))

    return _let(graph, of_graph)


def _one_hot(place: Column, size: int) -> Column:
    zero = F.lit(0.0).cast("float")
    return F.concat(F.array_repeat(zero, place), F.array(F.lit(1.0).cast("float")), F.array_repeat(zero, F.lit(size - 1) - place))


def circular_bits(rows: DataFrame, graph: str = "graph", radius: int = 2, bits: int = 1024, out: str = "bits") -> DataFrame:
    """``rows`` with ``out``: the sorted numbers of the bits that are on, none for a structure that is not valid.

    An atom's number is a hash of its symbol, charge, degree, hydrogens, isotope and whether it lies in a ring and is
    aromatic; each round hashes it with the sorted orders and numbers of its neighbours.  All numbers of all rounds
    are folded into ``bits``.  Numbers are hashes of this package: bits differ from those of other programs.
    """

    def first(x: Column) -> Column:
        return hash32(x["symbol"], x["charge"], x["degree"], x["hydrogens"], F.coalesce(x["isotope"], F.lit(0)), x["in_ring"].cast("int"), x["aromatic"].cast("int"))

    def rounds(g: Column, numbers: Column, k: int) -> Column:
        """The numbers of rounds ``k`` and later."""
        if k > radius:
            return numbers

        def around(number: Column, i: Column) -> Column:
            mine = F.filter(g["bonds"], lambda b: (b["a"] == i) | (b["b"] == i))
            other = F.transform(mine, lambda b: F.struct((b["order"] * 2).cast("int").alias("o"), F.get(numbers, F.when(b["a"] == i, b["b"]).otherwise(b["a"])).alias("n")))
            said = F.array_join(F.transform(F.array_sort(other), lambda s: F.concat_ws("-", s["o"].cast("string"), s["n"].cast("string"))), ",")
            return hash32(str(k), number, said)

        return F.concat(numbers, _let(F.transform(numbers, around), lambda later: rounds(g, later, k + 1)))

    def all_numbers(g: Column) -> Column:
        return _let(F.transform(g["atoms"], first), lambda numbers: rounds(g, numbers, 1))

    folded = F.transform(_let(F.col(graph), all_numbers), lambda x: F.pmod(x, F.lit(bits)).cast("int"))
    return rows.withColumn(out, F.array_sort(F.array_distinct(folded)))
