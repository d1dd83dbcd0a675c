"""Secret scans: fixed patterns plus a randomness test battery, in native expressions only.

Candidate strings (long runs of encoding characters) get an encoding: hex, base32, base36 (hex and
base36 also in parts with '-' or '_' between) or base64.  Three tests look at their characters:
chi-squared uniformity over the alphabet (as the unbiased repeat rate), Wald-Wolfowitz runs of
character classes and lag-1 serial correlation of alphabet positions.  The null hypothesis is ordinary
writing of that encoding: words, identifiers, paths and urls repeat letters, stay in a class for longer
and drift less.  Each test gives a normal score by length and encoding against that null; the scores
add up to one, whose spread allows for their dependence, and so to one p-value.  Short strings can
hardly reach small values, so length enters through the null itself and through the strata.  Strings
more regular than randomness allows are structured and never a finding.  Within each stratum
(encoding by length band) Benjamini-Hochberg bounds the share of false findings, on a table of p-value
steps that is as small for any corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The base patterns; the second group of the first holds the value (fixed values of the contract).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run, so the minimum may stand in the pattern
KINDS = ("assign", "access", "hex", "random")

#: '=' belongs to a run only as padding at its end, so the value of NAME=VALUE is a run of its own.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
#: encoding -> (alphabet, whole-string pattern, first positions of its further character classes)
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", (10,)),
    "hexparts": ("0123456789abcdef", r"^(?=.*[_-])(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f_-]+|[0-9A-F_-]+)=*$", (10,)),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", (26,)),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z]+|[0-9A-Z]+)$", (10,)),
    "base36parts": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[_-])(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z_-]+|[0-9A-Z_-]+)=*$", (10,)),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$", (26, 52, 62)),
}
#: What ordinary strings show, by encoding: repeat rate (mean, spread / n, spread / sqrt(n)), changes of class
#: for each step and serial correlation (mean, spread / sqrt(n)), and the spread of the sum of the three scores.  Fitted to 25,000 paths, identifiers,
#: constants and urls of installed programs and their texts; the spreads cover their tails.
ORDINARY = {
    "hex": (0.09, 0.0, 0.11, 0.15, 0.5, 0.0, 1.1, 1.8),
    "hexparts": (0.09, 0.0, 0.11, 0.15, 0.5, 0.0, 1.1, 1.8),
    "base32": (0.045, 0.0, 0.085, 0.10, 0.32, 0.0, 1.1, 1.8),
    "base36": (0.05, 0.0, 0.085, 0.11, 0.32, 0.07, 1.1, 1.8),
    "base36parts": (0.05, 0.0, 0.085, 0.11, 0.32, 0.07, 1.1, 1.8),
    "base64": (0.042, 0.35, 0.0, 0.40, 0.42, 0.09, 1.05, 1.4),
}
#: Changes of class for each step of uniform strings.
UNIFORM_CHANGES = {"hex": 0.469, "hexparts": 0.469, "base32": 0.305, "base36": 0.401, "base36parts": 0.401, "base64": 0.645}
#: Weight of the serial score beside the other two, and bounds of a score.
SERIAL, SCORES = 0.4, (-20.0, 6.0)
#: single-case runs in parts (UUIDs, tokens with a prefix): '-' and '_' only part them and are not tested
PARTED = ("hexparts", "base36parts")
FALSE_DISCOVERIES = 0.05
#: Spreads of uniform strings beyond which one is too regular to be random.
STRUCTURED = 4.0
#: p-values are kept in steps of a sixteenth of a power of ten, over 20 powers
STEPS, POWERS = 16, 20
SPAN = "array<struct<s:int,e:int,t:string>>"
PLACED = "array<struct<s:int,kind:int,e:int>>"
#: spans gathered or compared at once
PIECE = 128


def _grown(acc: Column, x: Column) -> list[Column]:
    """The fields ``cur`` and ``done`` of an accumulator with one more element.  Elements gather in
    pieces of PIECE, so that appending n of them is not n copies of all before."""
    full = F.size(acc["cur"]) >= PIECE
    cur = F.when(full, F.array(x)).otherwise(F.concat(acc["cur"], F.array(x)))
    return [cur.alias("cur"), F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done")]


def _none(kind: str) -> list[Column]:
    return [F.expr(f"cast(array() as {kind})").alias("cur"), F.expr(f"cast(array() as array<{kind}>)").alias("done")]


def found(text: Column, matches: Column, pattern: str) -> Column:
    """Spans (start, end, string) of ``matches``, in code points: the lengths of what stands
    between the matches add up to the starts."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), *_grown(acc, F.struct(start.alias("s"), end.alias("e"), x["m"].alias("t"))))

    pairs = F.arrays_zip(gaps.alias("g"), matches.alias("m"))
    walk = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), *_none(SPAN)), step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))
    return F.when(F.size(matches) > 0, walk).otherwise(F.expr(f"cast(array() as {SPAN})"))


def blocks(spans: Column) -> Column:
    """Spans in order, in pieces with their smallest start and largest end."""
    walk = F.aggregate(spans, F.struct(*_none(PLACED)), lambda acc, x: F.struct(*_grown(acc, x)), lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    ends = lambda p: F.array_max(F.transform(p, lambda x: x["e"]))
    return F.transform(F.filter(walk, lambda p: F.size(p) > 0), lambda p: F.struct(p[0]["s"].alias("lo"), ends(p).alias("hi"), p.alias("spans")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution: a logistic approximation, and an upper bound far out."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-8.0))
    return F.when(z < 3, 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))).otherwise(F.exp(-z * z / 2) / (z * 2.5066282746))


def _sum(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))


def _pick(enc: Column, of: dict) -> Column:
    """A constant of an encoding."""
    out = F.lit(None)
    for name, value in of.items():
        out = F.when(enc == name, F.lit(value)).otherwise(out)
    return out


def battery(cands: Column) -> tuple[Column, ...]:
    """Stages that turn spans into (s, e, stratum, step); each is to be its own projection."""

    def inferred(c: Column) -> Column:
        body = F.regexp_replace(c["t"], "=+$", "")
        enc = F.lit(None).cast("string")
        for name, (_, pattern, _) in reversed(ENCODINGS.items()):
            enc = F.when(body.rlike(pattern), F.lit(name)).otherwise(enc)
        body = F.when(enc.isin(*PARTED), F.regexp_replace(body, "[_-]", "")).otherwise(body)
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), body.alias("t"), enc.alias("enc"))

    def coded(c: Column) -> Column:
        enc = c["enc"]
        plain = F.when(enc.isin("hex", "base36", *PARTED), F.lower(c["t"])).otherwise(c["t"])
        alphabet = _pick(enc, {k: e[0] for k, e in ENCODINGS.items()})
        chars = F.split(plain, "")
        xs = F.transform(F.filter(chars, lambda ch: ch != ""), lambda ch: F.least(F.instr(alphabet, ch), F.length(alphabet)).cast("double") - 1)
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), enc.alias("enc"), xs.alias("x"))

    def classed(c: Column) -> Column:
        cuts = [_pick(c["enc"], {k: float([*e[2], 99, 99][i]) for k, e in ENCODINGS.items()}) for i in range(3)]
        kinds = F.transform(c["x"], lambda x: sum(((x >= cut).cast("int") for cut in cuts[1:]), (x >= cuts[0]).cast("int")))
        return F.struct(*[c[f].alias(f) for f in ("s", "e", "enc", "x")], kinds.alias("kinds"))

    def summed(c: Column) -> Column:
        # every sum is worked out once; none is inside another one's loop
        xs, kinds = c["x"], c["kinds"]
        at = F.sequence(F.lit(2), F.size(xs))
        squares = _sum(F.array_distinct(xs), lambda v: F.pow(F.size(F.filter(xs, lambda y: y == v)).cast("double"), 2))
        turns = _sum(at, lambda i: F.when(F.element_at(kinds, i) != F.element_at(kinds, i - 1), 1.0).otherwise(0.0))
        return F.struct(
            c["s"].alias("s"), c["e"].alias("e"), c["enc"].alias("enc"), F.size(xs).cast("double").alias("n"), squares.alias("squares"), turns.alias("turns"),
            _sum(xs, lambda v: v).alias("total"), _sum(xs, lambda v: v * v).alias("power"),
            _sum(at, lambda i: F.element_at(xs, i) * F.element_at(xs, i - 1)).alias("cross"), (xs[0] + F.element_at(xs, -1)).alias("ends"),
        )

    def tested(c: Column) -> Column:
        n, enc = c["n"], c["enc"]
        rate, rate_n, rate_root, change, change_root, serial, serial_root, sum_spread = (_pick(enc, {k: v[i] for k, v in ORDINARY.items()}) for i in range(8))
        bound = lambda z: F.greatest(F.least(z, F.lit(SCORES[1])), F.lit(SCORES[0]))
        root = F.sqrt(n)
        repeats, changes = (c["squares"] - n) / (n * (n - 1)), c["turns"] / (n - 1)
        mean = c["total"] / n
        spread = c["power"] - n * mean * mean
        lag = c["cross"] - mean * (2 * c["total"] - c["ends"]) + (n - 1) * mean * mean
        lagged = F.when(spread > 1e-6, lag / spread).otherwise(1.0)
        score = bound((rate - repeats) / (rate_n / n + rate_root / root)) + bound((changes - change) / (change_root / root)) + SERIAL * bound((serial - lagged) / (serial_root / root))
        # regular patterns: classes that change too often, ordered alphabets, symbols spread too evenly
        uniform = _pick(enc, UNIFORM_CHANGES)
        size = _pick(enc, {k: float(min(64, len(e[0]))) for k, e in ENCODINGS.items()})
        structured = (
            (changes - uniform > STRUCTURED * F.sqrt(uniform * (1 - uniform) / (n - 1))) | (F.abs(lagged) > STRUCTURED / root)
            | (repeats * size < 1 - STRUCTURED * F.sqrt(2 * size) / n)
        )
        p = F.when(structured, F.lit(1.0)).otherwise(_tail(score / sum_spread))
        step = F.least(F.floor(-F.log10(p) * STEPS), F.lit(STEPS * POWERS)).cast("int")
        band = F.least(F.floor(F.log2(n / 20)), F.lit(4)).cast("string")
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.concat(enc, F.lit("-"), band).alias("stratum"), step.alias("step"))

    return (
        F.filter(F.transform(cands, inferred), lambda c: c["enc"].isNotNull() & (F.length(c["t"]) >= 20)),
        coded,
        classed,
        summed,
        tested,
    )


def thresholds(tested: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """The smallest accepted step of each stratum under Benjamini-Hochberg.

    What comes to the driver is one number for each of at most 30 strata.
    """
    from pyspark.sql import Window as W

    counts = tested.select(F.explode("tests").alias("c")).groupBy("c.stratum", "c.step").count()
    by = W.partitionBy("stratum")
    most = F.pow(F.lit(10.0), -F.col("step") / F.lit(float(STEPS)))  # the largest p-value of a step
    passed = counts.withColumn("m", F.sum("count").over(by)).withColumn("cum", F.sum("count").over(by.orderBy(F.desc("step"))))
    rows = passed.where(most <= q * F.col("cum") / F.col("m")).groupBy("stratum").agg(F.min("step").alias("step")).collect()
    return {r["stratum"]: r["step"] for r in rows}


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per document: ``key``, counts of base findings, base_sha256, all spans and n_random.

    Null text is empty and has no findings (the checksum of the empty string).  Repeated rows are
    scanned each.  Two passes: the text is read once and leaves only spans, written to the shared
    folder; the false-discovery limits come from those.  Random spans inside a base span are not
    repeated.  No shuffle but that of the small table of p-value steps.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    scan = docs.select(F.col(key).alias("__key"), body.alias("__text"))
    scan = scan.select(
        "*",
        F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(0)).alias("__a"),
        F.regexp_extract_all("__text", F.lit(ACCESS), F.lit(0)).alias("__k"),
        F.regexp_extract_all("__text", F.lit(HEX), F.lit(0)).alias("__h"),
        F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)).alias("__c"),
    )
    scan = scan.select(
        "__key",
        F.filter(found(F.col("__text"), F.col("__a"), ASSIGN), lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 6).alias("a"),
        F.filter(found(F.col("__text"), F.col("__k"), ACCESS), lambda x: x["e"] - x["s"] >= 20).alias("k"),
        found(F.col("__text"), F.col("__h"), HEX).alias("h"),
        F.when(F.exists("__c", lambda t: t.rlike("[0-9]")), found(F.col("__text"), F.col("__c"), CANDIDATE)).otherwise(F.expr(f"cast(array() as {SPAN})")).alias("c"),
    )
    keep, coded, classed, summed, tested = battery(F.col("c"))
    scan = scan.withColumn("c", keep)
    scan = scan.withColumn("c", F.transform(F.transform(F.transform("c", coded), classed), summed))
    scan = scan.withColumn("tests", F.transform("c", tested)).drop("c")
    ends = lambda c, kind: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    scan = scan.select(
        "__key",
        F.size("a").cast("long").alias("n_assign"),
        F.size("k").cast("long").alias("n_access"),
        F.size("h").cast("long").alias("n_hex"),
        blocks(F.array_sort(F.concat(ends(F.col("a"), 0), ends(F.col("k"), 1), ends(F.col("h"), 2)))).alias("base"),
        "tests",
    )
    scan = materialize(scan, "secrets")
    limit = thresholds(scan, q)
    passed = [(F.lit(s), n) for s, n in sorted(limit.items())]

    def accepted(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [(c["stratum"] == s) & (c["step"] >= n) for s, n in passed], F.lit(False))

    def alone(c: Column) -> Column:
        return ~F.exists("base", lambda p: (p["lo"] <= c["s"]) & (p["hi"] >= c["e"]) & F.exists(p["spans"], lambda b: (b["s"] <= c["s"]) & (b["e"] >= c["e"])))

    random = ends(F.filter("tests", lambda c: accepted(c) & alone(c)), 3)
    base = F.flatten(F.transform("base", lambda p: p["spans"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return scan.select(
        F.col("__key").alias(key), "n_assign", "n_access", "n_hex",
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.concat(base, random)).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )
