"""Annotation of pairs: keyword classes, mediating entities ranked from bindings, per-type summaries.

Bindings: (node, edge_type, entity_id, entity_name, action, pos); pos is the row's place in the
node's list of that type (see :func:`with_positions`), counted before any duplicate is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import PD_KEYWORDS, PK_KEYWORDS, first_by_keyword, keyword_hits, keyword_label
from ..sources.stage import bounded_broadcast, staged
from .grid import met_in_cells
from .kg import numbered_entities

# Fixed values -------------------------------------------------------------------------------
PK_ROLE_PAIRS = (
    ("inhibitor", "substrate"), ("inducer", "substrate"), ("substrate", "inhibitor"), ("substrate", "inducer"), ("inhibitor", "inhibitor"),
)
PK_SUBTYPES = (
    ("metabolism", ("enzyme",)), ("serum concentration", ("enzyme", "transporter")), ("bioavailability", ("enzyme", "transporter")),
    ("excretion", ("transporter",)), ("absorption", ("transporter",)), ("protein binding", ("carrier",)),
)
PK_DEFAULT = ("enzyme", "transporter")
PD_HIGH = (
    ("inhibitor", "inhibitor"), ("agonist", "agonist"), ("antagonist", "antagonist"), ("inhibitor", "antagonist"), ("antagonist", "inhibitor"),
    ("agonist", "activator"), ("activator", "agonist"), ("activator", "activator"),
    ("positive allosteric modulator", "positive allosteric modulator"), ("inverse agonist", "antagonist"), ("antagonist", "inverse agonist"),
    ("partial agonist", "agonist"), ("agonist", "partial agonist"), ("partial agonist", "antagonist"), ("antagonist", "partial agonist"),
    ("binder", "antagonist"), ("antagonist", "binder"), ("binder", "agonist"), ("agonist", "binder"), ("binder", "inhibitor"),
    ("inhibitor", "binder"), ("ligand", "ligand"),
)
PD_LOW = (
    ("agonist", "modulator"), ("modulator", "agonist"), ("antagonist", "modulator"), ("modulator", "antagonist"), ("inhibitor", "modulator"),
    ("modulator", "inhibitor"), ("binder", "modulator"), ("modulator", "binder"), ("modulator", "partial agonist"),
    ("partial agonist", "modulator"), ("inhibitor", "agonist"), ("agonist", "inhibitor"), ("agonist", "antagonist"),
    ("antagonist", "agonist"), ("activator", "antagonist"), ("antagonist", "activator"), ("activator", "inhibitor"), ("inhibitor", "activator"),
)
PD_TARGET_WORDS = (
    ("anticoagulant", ("thrombin", "coagulation", "factor", "platelet", "fibrin")),
    ("qtc prolongation", ("kcnh2", "herg", "potassium channel", "cardiac", "ion channel")),
    ("arrhythmia", ("kcnh2", "herg", "cardiac", "sodium channel", "potassium")),
    ("bradycardia", ("beta", "adrenergic", "cholinergic", "muscarinic")),
    ("tachycardia", ("adrenergic", "dopamine", "thyroid")),
    ("bleeding", ("coagulation", "platelet", "thrombin", "fibrin")),
    ("hemorrhage", ("coagulation", "platelet", "anticoagulant")),
    ("hypotension", ("adrenergic", "angiotensin", "vasopressin", "renin", "alpha")),
    ("hypertension", ("adrenergic", "angiotensin", "renin", "alpha")),
    ("cns depression", ("gaba", "opioid", "serotonin", "histamine", "nmda", "glutamate")),
    ("sedation", ("gaba", "opioid", "histamine", "benzodiazepine")),
    ("serotonin syndrome", ("serotonin", "5-hydroxytryptamine", "5-ht")),
    ("myopathy", ("hmg-coa", "statin", "coq10", "myopathy")),
    ("nephrotoxicity", ("renal", "kidney", "proximal tubule")),
    ("seizure", ("gaba", "sodium channel", "glutamate", "nmda")),
    ("extrapyramidal", ("dopamine", "d2", "d1")),
    ("analgesic", ("opioid", "cyclooxygenase", "prostaglandin", "cox")),
    ("antihypertensive", ("adrenergic", "angiotensin", "calcium channel")),
    ("antidepressant", ("serotonin", "noradrenaline", "dopamine")),
    ("immunosuppression", ("calcineurin", "mtor", "interleukin")),
    ("sedative", ("gaba", "histamine", "benzodiazepine")),
    ("respiratory depression", ("opioid", "gaba", "respiratory")),
    ("myelosuppression", ("dna", "topoisomerase", "dihydrofolate")),
    ("hypoglycemia", ("insulin", "glucose", "sulfonylurea")),
    ("hyperkalemia", ("potassium", "aldosterone", "renin")),
    ("neuromuscular blockade", ("acetylcholine", "nicotinic", "neuromuscular")),
)
NO_RELEVANCE = 99
# ---------------------------------------------------------------------------------------------


def label_types(types: DataFrame, text: str = "ddi_type", pk=PK_KEYWORDS, pd=PD_KEYWORDS) -> DataFrame:
    """(text, pk_pd_label, matched_pk_keywords, matched_pd_keywords) of the distinct texts."""
    t = types.select(text).where(F.col(text).isNotNull()).distinct()
    t = t.select(text, keyword_hits(F.col(text), pk).alias("__pk"), keyword_hits(F.col(text), pd).alias("__pd"))
    return t.select(
        text, keyword_label(F.col("__pk"), F.col("__pd")).alias("pk_pd_label"),
        F.array_join("__pk", "; ").alias("matched_pk_keywords"), F.array_join("__pd", "; ").alias("matched_pd_keywords"),
    )


def with_positions(bindings: DataFrame, order: list[str], node: str = "node", kind: str = "edge_type") -> DataFrame:
    return bindings.withColumn("pos", F.row_number().over(W.partitionBy(node, kind).orderBy(*order)) - 1)


def entity_ranks(bindings: DataFrame) -> DataFrame:
    """First place of each entity in its node's list of a type."""
    return bindings.groupBy("node", "edge_type", "entity_id").agg(F.min("pos").alias("rank"))


def pk_types(text: Column) -> Column:
    """Entity types to search, in order, by the first subtype word of the text."""
    arr = lambda ts: F.array(*map(F.lit, ts))
    return first_by_keyword(text, [(k, arr(ts)) for k, ts in PK_SUBTYPES], arr(PK_DEFAULT))


def pd_relevance(text: Column, target: Column) -> Column:
    """Place of the first target word under the first disease word of the text that has one."""
    t, n = F.lower(text), F.lower(target)
    out = F.lit(NO_RELEVANCE)
    for disease, words in reversed(PD_TARGET_WORDS):
        place = F.lit(None).cast("int")
        for i, w in reversed(list(enumerate(words))):
            place = F.when(F.contains(n, F.lit(w)), F.lit(i)).otherwise(place)
        out = F.when(F.contains(t, F.lit(disease)) & place.isNotNull(), place).otherwise(out)
    return out


def role_pattern(a: Column, b: Column) -> Column:
    return (
        F.when(a.isin("inhibitor", "inducer") & (b == "substrate"), F.concat(a, F.lit("-substrate")))
        .when(b.isin("inhibitor", "inducer") & (a == "substrate"), F.concat(b, F.lit("-substrate")))
        .when((a == "inhibitor") & (b == "inhibitor"), F.lit("inhibitor-inhibitor"))
        .otherwise(F.concat(a, F.lit("-"), b))
    )


def mechanism_chain(a: Column, act_a: Column, b: Column, act_b: Column, entity: Column, kind: Column) -> Column:
    """A line from one node over the entity to the other.  An inhibitor or inducer points at the
    entity, which handles the substrate; any other two actions meet at the entity."""
    drives = lambda act: act.isin("inhibitor", "inducer")
    verb = F.when(kind == "transporter", "transports").otherwise("metabolizes")
    one_way = lambda x, act, y: F.format_string("%s --[%s]--> %s --[substrate: %s]--> %s", x, act, entity, verb, y)
    meet = F.format_string("%s --[%s]--> %s <--[%s]-- %s", a, act_a, entity, act_b, b)
    return F.when(drives(act_a) & (act_b == "substrate"), one_way(a, act_a, b)).when(drives(act_b) & (act_a == "substrate"), one_way(b, act_b, a)).otherwise(meet)


def _action(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def shared_candidates(
    pairs: DataFrame, bindings: DataFrame, types: Column, kinds: tuple[str, ...], roles: tuple, a: str = "a", b: str = "b", made: dict[str, Column] | None = None, distinct: bool = False
) -> DataFrame:
    """Every (pair, binding of a, binding of b) on one entity that both hold in one of ``roles`` (actions of a and b), of the first of the
    pair's types that has any, with each end's rank (its first place of the entity) and a's name at it.  The bindings of such
    an entity are all there, in whatever role.

    ``types`` are among ``kinds``.  Pairs move once, by themselves, to meet an array of codes of each end: a holds what b's entities and
    actions must be.  Only pairs that share any go on to the bindings themselves.  ``made``: columns that follow from
    the pair's others and are made then.  ``distinct``: equal pairs count once.
    """
    told = bounded_broadcast(numbered_entities(bindings.where(F.col("edge_type").isin(*kinds))))
    binding = F.struct("entity_name", _action("action").alias("action"), "pos")
    held = bindings.join(told, ["edge_type", "entity_id"]).groupBy("node", "edge_type", "code").agg(
        F.min("pos").alias("rank"), F.min_by("entity_name", "pos").alias("first_name"), F.collect_list(binding).alias("rows")
    )
    held = staged(held.where("node IS NOT NULL"), "held")
    theirs = sorted({y for _, y in roles})
    key = lambda y: F.col("code").cast("long") * len(theirs) + theirs.index(y)
    acts = F.col("rows.action")
    asks = [F.when(F.array_contains(acts, x), F.array(*[key(y) for z, y in roles if z == x])) for x in sorted({x for x, _ in roles})]
    has = F.array_compact(F.array(*[F.when(F.array_contains(acts, y), key(y)) for y in theirs]))
    both = held.select("node", F.flatten(F.array_compact(F.array(*asks))).alias("asks"), has.alias("has")).groupBy("node")
    both = staged(both.agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("asks", "has")]), "codes")
    side = lambda end, c: both.where(F.size(c) > 0).select(F.col("node").alias(end), F.col(c).alias(f"__{c}"))
    met = met_in_cells(pairs, side(a, "asks"), side(b, "has"), a, b, "inner", distinct)
    hits = F.array_distinct(F.transform(F.array_intersect("__asks", "__has"), lambda x: F.floor(x / len(theirs)).cast("int")))
    met = met.where(F.arrays_overlap("__asks", "__has")).withColumn("__hits", hits).drop("__asks", "__has").withColumns(made or {})
    # codes follow the types, so each has a range of them
    ranges = [tuple(r) for r in told.groupBy("edge_type").agg(F.min("code"), F.max("code")).collect()]
    within = lambda x, k: reduce(lambda p, r: p | ((k == r[0]) & x.between(r[1], r[2])), ranges, F.lit(False))
    of_type = F.transform(types, lambda k: F.struct(k.alias("edge_type"), F.filter("__hits", lambda x: within(x, k)).alias("codes")))
    met = met.withColumn("__first", F.get(F.filter(of_type, lambda x: F.size(x["codes"]) > 0), F.lit(0))).where("__first IS NOT NULL").drop("__hits")
    met = met.withColumn("edge_type", F.col("__first.edge_type")).withColumn("code", F.explode("__first.codes")).drop("__first").hint("merge")  # more than their estimate
    for s, end in (("a", a), ("b", b)):
        own = held.select(F.col("node").alias(end), "code", F.col("rank").alias(f"rank_{s}"), F.col("first_name").alias(f"first_{s}"), F.col("rows").alias(f"__{s}"))
        met = met.join(own if s == "a" else own.drop("first_b"), [end, "code"])
    met = met.withColumn("__x", F.explode("__a")).drop("__a").withColumn("__y", F.explode("__b")).drop("__b")
    sides = {f"{out}_{s}": F.col(f"{x}.{c}") for s, x in (("a", "__x"), ("b", "__y")) for out, c in (("name", "entity_name"), ("act", "action"), ("pos", "pos"))}
    return met.withColumns(sides).drop("__x", "__y").join(told.drop("edge_type"), "code").drop("code")


def pk_mediators(pairs: DataFrame, bindings: DataFrame, text: str = "ddi_type", a: str = "a", b: str = "b", made: Column | None = None, distinct: bool = False) -> DataFrame:
    """The best PK mediator of each pair: first entity type with a candidate, then lowest rank sum,
    name, id and places.  ``n_candidates`` counts the others.  ``made``: ``text``, from the pair's other columns."""
    kinds = tuple(dict.fromkeys((*(k for _, ks in PK_SUBTYPES for k in ks), *PK_DEFAULT)))
    c = shared_candidates(pairs, bindings, pk_types(F.col(text)), kinds, PK_ROLE_PAIRS, a, b, made if made is None else {text: made}, distinct)
    roles = [(F.col("act_a") == x) & (F.col("act_b") == y) for x, y in PK_ROLE_PAIRS]
    ok = roles[0]
    for r in roles[1:]:
        ok = ok | r
    c = c.where(ok)
    pair = W.partitionBy(a, b)
    c = c.withColumn("rank_sum", F.col("rank_a") + F.col("rank_b"))
    w = pair.orderBy("rank_sum", "name_a", "entity_id", "pos_a", "pos_b")
    best = c.withColumn("__r", F.row_number().over(w)).withColumn("n_candidates", F.count("*").over(pair) - 1).where("__r = 1")
    return best.select(
        a, b, text, F.col("entity_id").alias("key_entity_id"), F.col("name_a").alias("key_entity_name"), F.col("edge_type").alias("key_entity_type"),
        F.col("act_a").alias("action_a"), F.col("act_b").alias("action_b"), role_pattern(F.col("act_a"), F.col("act_b")).alias("match_pattern"), "rank_sum", "n_candidates",
    )


def pd_confidence(a: Column, b: Column) -> Column:
    both = F.concat(a, F.lit("|"), b)
    return F.when(both.isin(*["|".join(p) for p in PD_HIGH]), "high").when(both.isin(*["|".join(p) for p in PD_LOW]), "low")


def pd_mediators(pairs: DataFrame, bindings: DataFrame, text: str = "ddi_type", a: str = "a", b: str = "b", kind: str = "target", made: Column | None = None, distinct: bool = False) -> DataFrame:
    """The best PD mediator: per entity the first high pair of actions, else the first low one; then
    high first, relevance of the target to the text, rank sum, name, id.  ``made``: ``text``, from the pair's other columns."""
    c = shared_candidates(pairs, bindings, F.array(F.lit(kind)), (kind,), (*PD_HIGH, *PD_LOW), a, b, made if made is None else {text: made}, distinct)
    c = c.withColumn("confidence", pd_confidence(F.col("act_a"), F.col("act_b"))).where("confidence IS NOT NULL").withColumn("__low", (F.col("confidence") != "high").cast("int"))
    per = W.partitionBy(a, b, "entity_id").orderBy("__low", "pos_a", "pos_b")
    c = c.withColumn("__e", F.row_number().over(per)).where("__e = 1")
    c = c.withColumn("rank_sum", F.col("rank_a") + F.col("rank_b")).withColumnRenamed("first_a", "first_name")
    c = c.withColumn("relevance", pd_relevance(F.col(text), F.col("first_name")))
    w = W.partitionBy(a, b).orderBy("__low", "relevance", "rank_sum", "first_name", "entity_id")
    best = c.withColumn("__r", F.row_number().over(w)).withColumn("n_candidates", F.count("*").over(W.partitionBy(a, b)) - 1).where("__r = 1")
    convergent = (F.col("act_a") == F.col("act_b")) | (F.col("confidence") == "high")
    return best.select(
        a, b, text, F.col("entity_id").alias("key_entity_id"), F.col("first_name").alias("key_entity_name"), F.lit(kind).alias("key_entity_type"),
        F.col("act_a").alias("action_a"), F.col("act_b").alias("action_b"), "confidence",
        F.when(convergent, "convergent").otherwise("opposing").alias("chain_type"), "relevance", "rank_sum", "n_candidates",
    )


def type_coverage(pairs: DataFrame, by: str = "ddi_type", label: str = "pk_pd_label", flag: str = "has_key_entity", order: str = "ord") -> DataFrame:
    return pairs.groupBy(by).agg(
        F.min_by(label, order).alias(label), F.count("*").alias("n_pairs"), F.sum(F.col(flag).cast("bigint")).alias("n_with_key_entity"),
        F.bround(100.0 * F.sum(F.col(flag).cast("bigint")) / F.count("*"), 1).alias("coverage_pct"),
    )


def top_names(rows: DataFrame, by: str, name: str, k: int = 3, out: str = "top3_key_entities") -> DataFrame:
    """``name(count); ...`` of the k most frequent names of each group, ties by name."""
    n = rows.where(F.col(name).isNotNull() & (F.trim(F.col(name)) != "")).groupBy(by, name).agg(F.count("*").alias("__n"))
    top = n.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("__n"), name))).where(F.col("__r") <= k)
    text = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(name).alias("__v"), "__n"))), lambda x: F.format_string("%s(%d)", x["__v"], x["__n"]))
    return top.groupBy(by).agg(F.array_join(text, "; ").alias(out))


def type_a_tables(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mediating entities, action pairs) of the pairs that have a key entity."""
    rows = annotated.where(F.col("has_key_entity"))
    return (
        rows.select("drug_a_id", "drug_b_id", "pk_pd_label", F.col("key_entity_id").alias("entity_id"), F.col("key_entity_name").alias("entity_name"), F.col("key_entity_type").alias("entity_type")),
        rows.select("drug_a_id", "drug_b_id", "pk_pd_label", "action_drug_a", "action_drug_b", "match_pattern", "mechanism_chain", "chain_type", "confidence"),
    )
