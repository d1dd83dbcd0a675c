"""Core operators on small hand-made tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import scalars as S
from pairloom.operators import annotate, cleaning, diagnostics, folds, graph, kg, metrics, render, retrieval, sampling, scoring, validate


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("x")).first()[0]


def test_normalise_text(spark):
    d = spark.createDataFrame([("The metabolism of A+B (x) can be  increased when combined with aspirin.", "A+B (x)", "Aspirin"), ("plain", None, ""), ("keep \\E this a\\Eb", "a\\Eb", None)], "d string, a string, b string")
    out = [r[0] for r in d.select(S.normalize_text(F.col("d"), F.col("a"), F.col("b"))).collect()]
    assert out == ["The metabolism of can be increased when combined with", "plain", "keep \\E this"]


def test_scalars(spark):
    assert one(spark, S.tanimoto(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, S.bin_index(F.lit(5.0), F.array(*map(F.lit, [0.0, 5.0, 10.0])))) == 0
    assert one(spark, S.bin_index(F.lit(99.0), F.array(*map(F.lit, [0.0, 5.0, 10.0])))) == 1
    assert one(spark, S.slug(F.lit("Org/Model-1.5"))) == "org__model-1-5"
    assert one(spark, S.occurrences(F.lit("abcabcab"), "abc")) == 2
    assert one(spark, S.text_to_bool(F.lit(" True "))) is True
    assert one(spark, S.mask_chain(F.lit("CYP3A4, CYP2D6 and CYP1A2 CYP2C9"), [r"CYP\d[A-Z]?\d*"], "[M]")) == "[M] and [M]"
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, S.text_to_bool(F.lit("maybe")))


def test_seven_steps(spark):
    names = [chr(65 + i) for i in range(6)]
    rows = [(n, f"Drug{n}", "small molecule", "CCO", "approved") for n in names]
    rows += [("X", "DrugX", "biotech", "CCO", "approved"), ("Y", "DrugY", "small molecule", "C(C", "approved"), ("Z", "DrugZ", "small molecule", "CCO", "vet_approved"), ("M", "DrugM", "small molecule", "[Na+].CC", "approved;withdrawn")]
    drugs = spark.createDataFrame(rows, "drugbank_id string, name string, type string, smiles string, groups string")
    edges, k = [], 0
    ids = [r[0] for r in rows]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            edges.append((a, b, f"Drug{a} may raise Drug{b} levels." if (a, b) != ("A", "B") else "rare one", k))
            k += 1
    e = spark.createDataFrame(edges, "drug_a_id string, drug_b_id string, description string, ord long")
    done = cleaning.clean(drugs, e, {"t": drugs.select("drugbank_id")}, type_min=5, degree_min=4)
    stats = [(r["step"], r["n_drugs"], r["n_edges"], r["n_types"]) for r in done.stats.orderBy("step").collect()]
    assert stats == [(0, 10, 45, None), (1, 9, 36, None), (2, 8, 28, None), (3, 7, 21, None), (4, 7, 21, 2), (5, 7, 20, 1), (6, 6, 14, 1), (7, 6, 14, 1)]
    assert {r[0] for r in done.aux["t"].collect()} == set(names) and done.type_text.first()[0] == "may raise levels"


def test_pk_mediator_ranks_and_falls_through_types(spark):
    b = [("u", "enzyme", "e1", "Zeta", "inhibitor", 0), ("u", "enzyme", "e2", "Alpha", "inhibitor", 1), ("v", "enzyme", "e2", "Alpha", "Substrate ", 0), ("v", "enzyme", "e1", "Zeta", "substrate", 1), ("v", "transporter", "t1", "T", "substrate", 0), ("u", "transporter", "t1", "T", "inducer", 0), ("w", "transporter", "t1", "T", "substrate", 0)]
    bind = spark.createDataFrame(b, "node string, edge_type string, entity_id string, entity_name string, action string, pos int")
    pairs = spark.createDataFrame([("u", "v", "metabolism"), ("u", "w", "serum concentration"), ("v", "w", "metabolism")], "a string, b string, ddi_type string")
    out = {(r["a"], r["b"]): r for r in annotate.pk_mediators(pairs, bind).collect()}
    assert out["u", "v"]["key_entity_name"] == "Alpha" and out["u", "v"]["n_candidates"] == 1 and out["u", "v"]["match_pattern"] == "inhibitor-substrate"
    assert out["u", "w"]["key_entity_type"] == "transporter" and out["u", "w"]["match_pattern"] == "inducer-substrate" and ("v", "w") not in out


def test_pd_mediator_prefers_high_then_relevance(spark):
    b = [("u", "target", "x", "Opioid receptor", "agonist", 0), ("v", "target", "x", "Opioid receptor", "antagonist", 0), ("u", "target", "y", "Thrombin", "inhibitor", 1), ("v", "target", "y", "Thrombin", "inhibitor", 1), ("u", "target", "z", "Other", "inhibitor", 2), ("v", "target", "z", "Other", "inhibitor", 2)]
    bind = spark.createDataFrame(b, "node string, edge_type string, entity_id string, entity_name string, action string, pos int")
    r = annotate.pd_mediators(spark.createDataFrame([("u", "v", "risk of bleeding")], "a string, b string, ddi_type string"), bind).first()
    assert (r["key_entity_name"], r["confidence"], r["chain_type"], r["relevance"], r["n_candidates"]) == ("Thrombin", "high", "convergent", 2, 2)


def graph_edges(spark, n=60, m=600):
    g = random.Random(1)
    pairs = {tuple(sorted(g.sample(range(n), 2))) for _ in range(m)}
    return spark.createDataFrame(sorted(pairs), "a long, b long"), len(pairs)


def test_fold_invariants(spark):
    e, n = graph_edges(spark)
    nodes = spark.range(60).withColumnRenamed("id", "node")
    groups = folds.node_groups(nodes, 42)
    assert {r["grp"]: r["count"] for r in groups.groupBy("grp").count().collect()} == {"G1": 48, "G2": 12}
    f = folds.fair_folds(e, groups, 42)
    sizes = {r["split"]: r["count"] for r in f.groupBy("split").count().collect()}
    assert sum(sizes.values()) == n
    inner = sizes["train"] + sizes["val_s0"] + sizes["test_s0"]
    assert sizes["train"] == math.floor(inner * 0.9) and sizes["test_s0"] == math.ceil((inner - sizes["train"]) / 2)
    for s in ("s1", "s2"):
        assert sizes[f"test_{s}"] - sizes[f"val_{s}"] in (0, 1)
    again = folds.fair_folds(e.repartition(13), groups.repartition(3), 42)
    assert again.select("a", "b", "split").exceptAll(f.select("a", "b", "split")).isEmpty()
    audit = {r["split"]: r for r in validate.partition_audit(f, groups).collect()}
    assert audit["train"]["n_g2_0"] == sizes["train"] and audit["test_s2"]["n_g2_2"] == sizes["test_s2"]
    legacy = folds.legacy_folds(e, groups, 42)
    train = legacy.where("split = 'train'").select(F.explode(F.array("a", "b")).alias("n")).distinct().count()
    assert train == legacy.where("n_g2 = 0").select(F.explode(F.array("a", "b")).alias("n")).distinct().count()


def test_protocol_knobs():
    assert folds.resolve_protocol()["protocol"] == "fair" and folds.resolve_protocol(drug_ratio=2.0)["protocol"] == "legacy"
    for kw in ({"protocol": "fair", "drug_ratio": 1.5}, {"protocol": "legacy", "g1_ratio": 0.8}, {"protocol": "x"}, {"g1_ratio": 1.5}):
        with pytest.raises(ValueError):
            folds.resolve_protocol(**kw)


def test_negatives_are_one_to_one_and_never_positive(spark):
    e, _ = graph_edges(spark, 80, 300)
    groups = folds.node_groups(spark.range(80).withColumnRenamed("id", "node"), 1)
    f = folds.fair_folds(e, groups, 1).select("a", "b", "split").cache()
    neg = sampling.static_negatives(spark, f, groups, 1).cache()
    want = {r["split"]: r["count"] for r in f.where("split <> 'train'").groupBy("split").count().collect()}
    assert {r["split"]: r["count"] for r in neg.groupBy("split").count().collect()} == want
    assert neg.join(e, ["a", "b"], "left_semi").isEmpty() and neg.where("a >= b").isEmpty()


def test_indicators_by_hand(spark):
    tri = spark.createDataFrame([("a", "b", "c", 1, "PK-A"), ("d", "b", "c", 0, "PK-A"), ("a", "e", "c", 1, "Other")], "qa string, qb string, qa_prime string, label int, bucket string")
    preds = spark.createDataFrame([("R0", "a", "b", 0.9), ("R0", "b", "c", 0.4), ("R0", "d", "b", 0.2), ("R0", "e", "a", 0.7), ("R0", "c", "e", None), ("R2", "a", "b", 0.5)], "cond string, a string, b string, p double")
    out = {(r["indicator"], r["bucket"]): r for r in diagnostics.kps_f(tri, preds).collect()}
    assert out["KPS-F", "PK-A"]["value"] == pytest.approx(0.35) and out["KPS-F", "PK-A"]["n"] == 2
    assert out["KPS-F", "ALL"]["n"] == 2 and out["KPS-F", "ALL"]["value"] == pytest.approx(0.5) and out["KPS-F", "ALL"]["std"] == 0.0
    ch = {(r["indicator"], r["bucket"]): r for r in diagnostics.channel_deltas(tri, preds).collect()}
    assert ch["KPS-KG", "PK-A"]["value"] == pytest.approx(0.4) and ch["KPS-KG", "PK-A"]["n"] == 1 and ("KPS-KG", "PD-A") not in ch
    assert math.isnan(ch["KPS-Name", "PD-B"]["value"]) and ch["KPS-Name", "PD-B"]["n"] == 0
    assert {k[1] for k in ch if k[0] == "KPS-Name"} == set(diagnostics.BUCKETS)
    assert all(math.isnan(r["value"]) for r in diagnostics.ksai(tri, preds).collect())


def test_swaps_by_hand(spark):
    src = spark.createDataFrame([(1, 2, 1, 0)], "a long, b long, label int, prio int")
    pool = spark.createDataFrame([(3, 2, 0, 0), (4, 2, 1, 0), (2, 5, 0, 0), (1, 6, 0, 0)], "a long, b long, label int, prio int")
    got = {tuple(r) for r in diagnostics.swap_triples(src, pool).collect()}
    assert got == {(1, 2, 3, 1), (1, 2, 5, 1), (2, 1, 6, 1)}
    groups = spark.createDataFrame([(1, "G1"), (2, "G1"), (3, "G2"), (5, "G1"), (6, "G2")], "node long, grp string")
    assert {tuple(r) for r in diagnostics.swap_triples(src, pool, groups).collect()} == {(1, 2, 5, 1)}


def test_metrics_against_loops(spark):
    g = random.Random(3)
    rows = [("m", g.randint(0, 1), round(g.random(), 1)) for _ in range(80)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    pos, neg = [s for m, y, s in rows if m == "m" and y], [s for m, y, s in rows if m == "m" and not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    out = {r["g"]: r for r in metrics.roc_auc(df, ["g"]).collect()}
    assert out["m"]["auc"] == pytest.approx(auc) and math.isnan(out["one"]["auc"])
    ap, tp, n, last = 0.0, 0, 0, 0
    for s in sorted({s for *_, s in rows[:80]}, reverse=True):
        tp, n = tp + sum(p == s for p in pos), n + sum(p == s for p in pos) + sum(q == s for q in neg)
        ap, last = ap + (tp - last) / len(pos) * tp / n, tp
    assert {r["g"]: r["ap"] for r in metrics.average_precision(df, ["g"]).collect()}["m"] == pytest.approx(ap)
    k = metrics.cohen_kappa(spark.createDataFrame([("a", "a")] * 4 + [("b", "b")] * 3 + [("a", "b")] * 3, "x string, y string"), "x", "y").first()
    assert k["kappa"] == pytest.approx((0.7 - (0.7 * 0.4 + 0.3 * 0.6)) / (1 - (0.7 * 0.4 + 0.3 * 0.6)))
    nan = float("nan")
    runs = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 3.0), ("m", 3, nan), ("q", 1, nan)], "g string, seed int, value double")
    roll = metrics.seed_rollup(runs, ["g"]).collect()
    assert len(roll) == 1 and roll[0]["seeds"] == "1,2" and roll[0]["n_seeds"] == 2
    kept = {r["g"]: r for r in metrics.seed_rollup_all(runs, ["g"]).collect()}
    assert kept["q"]["n_seeds"] == 0 and kept["q"]["seeds"] == "1" and kept["q"]["mean"] is None


def test_graphs(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    n = spark.range(5).withColumnRenamed("id", "n")
    d = {(r["src"], r["node"]): r["dist"] for r in graph.shortest_paths(e, n, 5).collect()}
    assert d[0, 3] == 3 and d[4, 4] == 0 and (4, 0) not in d
    walk = {(r["start"], r["step"]): r["node"] for r in graph.biased_walk(e, n, 4, 1, 0.5, 2.0).collect()}
    assert all(abs(walk[s, k] - walk[s, k - 1]) == 1 for s, k in walk if k) and (4, 1) not in walk
    p = graph.google_rows(e, n)
    assert p.where("src = 0").first()["p"] == pytest.approx(0.85 + 0.15 / 5) and p.where("src = 4").first()["dst"] is None


def test_paths_of_any_length_from_every_node(spark):
    pairs = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 22), (22, 20)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    n = e.select(F.explode(F.array("src", "dst")).alias("n")).distinct().union(spark.createDataFrame([(30,)], "n long"))
    got = {(r["src"], r["node"]): r["dist"] for r in graph.shortest_paths(e, n).collect()}
    want = {(i, j): abs(i - j) for i in range(10) for j in range(10)} | {(i, j): int(i != j) for i in (20, 21, 22) for j in (20, 21, 22)} | {(30, 30): 0}
    assert got == want


def test_whole_graph_queries_equal_their_sql(spark):
    import duckdb
    from pairloom.plans import catalog

    con = duckdb.connect()
    for name in ("nation", "supplier", "part"):
        con.sql(f"CREATE VIEW {name} AS FROM '/root/testdata/sf0.01/{name}.parquet'")
    for q in ("g06_isolated_selfloops", "g12_shortest_paths", "g17_distance_relations"):
        got = sorted(map(tuple, catalog.queries()[q](spark, "/root/testdata/sf0.01").collect()))
        assert got == sorted(con.sql(catalog.oracle_sql()[q]).fetchall()), q


def test_retrieval(spark):
    long = kg.long_view({"enzyme": spark.createDataFrame([("d", "e", "E")], "drugbank_id string, enzyme_id string, enzyme_name string")})
    assert tuple(long.first()) == ("d", "enzyme", "e", "E", "", "")
    with pytest.raises(ValueError):
        kg.neighbours(long, "d", ["protein"])
    q = spark.createDataFrame([("a", "b")], "qa string, qb string")
    pool = spark.createDataFrame([("c", "d"), ("a", "x"), ("e", "f")], "ra string, rb string")
    names = spark.createDataFrame([("a", "k1"), ("c", "k1"), ("x", "k1"), ("e", "k9")], "node string, entity string")
    cand = retrieval.shared_entity_candidates(q, pool, names)
    assert [tuple(r) for r in cand.collect()] == [("a", "b", "c", "d")]
    ex = cand.select("qa", "qb", F.lit(1).alias("place"), "ra", "rb", F.lit(0.5).alias("score"))
    full = retrieval.padded(ex, q, pool, 4, 1).orderBy("place").collect()
    assert len(full) == 4 and [r["note"] for r in full] == ["", "padding", "padding", "padding"] and all("a" not in (r["ra"], r["rb"]) for r in full)
    assert retrieval.shared_evidence(ex, names).first()["shared_QA_CA"] == ["k1"]


def test_padding_avoids_the_query_in_a_skewed_pool(spark):
    pool = [("a", f"p{i}") for i in range(95)] + [(f"s{i}", f"t{i}") for i in range(4)] + [("a", "b")]
    q = [("a", f"q{i}") for i in range(60)] + [("a", "s0")]
    none = spark.createDataFrame([], "qa string, qb string, place int, ra string, rb string, score double")
    run = lambda pool: retrieval.padded(none, spark.createDataFrame(q, "qa string, qb string"), spark.createDataFrame(pool, "ra string, rb string"), 3, 1).collect()
    got = run(pool)
    assert len(got) == 3 * len(q) == len({(r["qa"], r["qb"], r["place"]) for r in got})
    assert all(r["note"] == "padding" and not {r["qa"], r["qb"]} & {r["ra"], r["rb"]} and (r["ra"], r["rb"]) in pool for r in got)
    assert {r["ra"] for r in got} == {"s0", "s1", "s2", "s3"}
    got = run([p for p in pool if "a" in p])
    assert len(got) == 3 * len(q) and {r["note"] for r in got} == {"padding_leaking_unavoidable"}


def test_rendering(spark):
    ctx = F.array(F.struct(F.lit("targets").alias("type"), F.array(F.lit("T1"), F.lit("T2")).alias("A"), F.array(F.lit("unknown")).alias("B")), F.struct(F.lit("smiles").alias("type"), F.array(F.lit("C")).alias("A"), F.array(F.lit("N")).alias("B")))
    a, b = F.lit("X"), F.lit("Y")
    assert one(spark, render.pair_block("one_hop_subgraph_sequence", a, b, ctx)) == "### [Prediction]:\nDrug A: X\nwhose targets are T1, T2\nwhose smiles are C.\nDrug B: Y\nwhose target is unknown\nwhose smiles are N.\n### Answer: "
    masked = one(spark, render.pair_block("OHS_Mask_Name_Entity", a, b, ctx, is_a=F.lit(True), key_name=F.lit("T2")))
    assert "Drug A: [DRUG_A]\nwhose targets are T1, [ENTITY]" in masked
    assert "whose targets are [ENTITY], T2" in one(spark, render.pair_block("ohs_mask_entity", a, b, ctx))
    assert one(spark, render.pair_block("one_hop_subgraph_single", a, b, ctx)).splitlines()[2] == "Drug A's Facts: (X, has targets, T1), (X, has targets, T2), (X, has smiles, C)"
    text = one(spark, render.prompt("zero_shot", "gemma-2", render.pair_block("zero_shot", a, b)))
    assert text.startswith("<start_of_turn>user\nTask: Binary") and text.endswith("### Answer:<end_of_turn>\n\n<start_of_turn>model")
    ex = F.array(F.struct(F.lit("P").alias("name_a"), F.lit("Q").alias("name_b"), F.lit("1").alias("label"), F.array(F.struct(F.lit("K").alias("name"), F.lit("enzyme").alias("type"))).alias("qa_ca"), *[F.expr("cast(array() as array<struct<name:string,type:string>>)").alias(c) for c in ("qb_cb", "qa_cb", "qb_ca")]))
    assert "Matching Evidence: (Query Drug A -> {enzyme: K} <- P); (Query Drug B -> {Structural Similarity} <- Q)" in one(spark, render.mechanism_examples(ex))
    assert render.model_family("ChatGLM") == "qwen" and render.chat_template("deepseek") == "llama" and render.method_name(None) == "zero_shot"


def test_audits(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), (" d", "e"), ("", "f"), (None, "g")], "a string, b string")
    r = validate.pair_key_audit(p).first()
    assert (r["n_null"], r["n_blank"], r["n_untrimmed"], r["n_self"], r["n_duplicate"]) == (1, 1, 1, 1, 1)
    with pytest.raises(validate.Invalid):
        validate.check_pairs(p)
    want = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    got = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 2.0), ("c", "d", float("nan"))], "a string, b string, p double")
    r = validate.prediction_audit(want, got).first()
    assert (r["n_missing"], r["n_unexpected"], r["n_not_finite"], r["n_out_of_range"]) == (0, 1, 1, 1)


def test_scoring_and_resume(spark, tmp_path):
    from pairloom.streaming import resume

    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "b")], "a string, b string")
    model = scoring.scorer("hash-baseline")
    path = str(tmp_path / "scores")
    assert resume.resume(spark, pairs.limit(1), model, path).count() == 1
    assert resume.resume(spark, pairs, model, path).count() == 2
    assert spark.read.parquet(path).count() == 2

    class Short:
        modality = "mol"

        def score(self, pairs, mask=None):
            return [0.1]

    with pytest.raises(Exception, match="scores for"):
        scoring.scored(pairs.coalesce(1), Short()).collect()
    pairs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        resume.stream_scores(spark, str(tmp_path / "in"), model, path, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(path).count() == 2


def test_range_numbers_and_features(spark):
    from pairloom.functions.numbering import range_numbered
    from pairloom.operators import features

    got = {r["id"]: r["place"] for r in range_numbered(spark.range(500).repartition(7), [F.desc("id")]).collect()}
    assert got == {i: 500 - i for i in range(500)}
    prints = spark.createDataFrame([(1, [1, 2]), (2, [2, 3]), (3, [])], "node long, bits array<int>")
    prof = features.reference_profiles(prints, spark.createDataFrame([(0, [1, 2]), (1, [3])], "pos int, bits array<int>"))
    assert {r["node"]: [round(x, 3) for x in r["profile"]] for r in prof.collect()} == {1: [1.0, 0.0], 2: [0.333, 0.5], 3: [0.0, 0.0]}
    pc = features.principal_components(prof, prof.where("node < 3"), 5).collect()
    assert len(pc) == 3 and sum(r["components"][0] for r in pc if r["node"] < 3) == pytest.approx(0)
    assert {(r["node"], r["bit"]) for r in features.print_edges(prints).collect()} == {(1, 1), (1, 2), (2, 2), (2, 3), (3, -1)}
    edges = features.interaction_edges(spark.createDataFrame([(1, 2)], "a long, b long"), prints)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (2, 1), (3, 3)}
    groups = spark.createDataFrame([(1, "G1"), (2, "G1"), (3, "G2")], "node long, grp string")
    kg_rows = spark.createDataFrame([(1, "enzyme", "e")], "node long, edge_type string, entity_id string")
    bio = features.biomedical_edges(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), groups, kg_rows, ("enzyme",))
    assert {tuple(r) for r in bio.collect()} == {("1", "2", 1), ("2", "1", 1), ("1", "entity:e", 2), ("entity:e", "1", 2)}


def test_audit_of_descriptions(spark):
    from pairloom.operators import audit

    rows = spark.createDataFrame([("d", "Blocks CYP3A4, CYP2D6 and Foo kinase; potential interactions.", ["Foo kinase", "Foo"]), ("e", None, None)], "drug_id string, text string, own array<string>")
    out = {r["drug_id"]: r for r in audit.mask_descriptions(rows).collect()}
    assert out["d"]["masked"] == "Blocks [MASKED_ENTITY] and [MASKED_ENTITY]; potential interactions." and out["d"]["n_replaced"] == 3 and out["e"]["masked"] == ""
    a = audit.audit_descriptions(rows)
    got = {r["drug_id"]: r for r in a.collect()}
    assert [(m["category"], m["start"]) for m in got["d"]["mentions"]] == [("short_form", 7), ("short_form", 15), ("ddi_phrase", 38), ("own_kg", 26), ("own_kg", 26)]
    assert audit.audit_summary(a).first()["descriptions_with_candidate_mentions"] == 1


def test_panel_and_winner(spark):
    tri = spark.createDataFrame([("a", "b", "c", 1, "PK-A")], "qa string, qb string, qa_prime string, label int, bucket string")
    preds = spark.createDataFrame([("base", "a", "b", 0.9), ("base", "c", "b", 0.4), ("mask_kg", "b", "a", 0.6)], "cond string, a string, b string, p double")
    out = {(r["indicator"], r["bucket"]): r for r in diagnostics.masked_panel(tri, preds).collect()}
    assert out["KPS-KG", "ALL"]["value"] == pytest.approx(0.3) and out["KPS-F", "PK-A"]["value"] == pytest.approx(0.5) and math.isnan(out["KPS-mol", "ALL"]["value"])
    rows = spark.createDataFrame([("s0", 10, 0.8), ("s0", 5, 0.8), ("s0", 1, float("nan"))], "split string, step int, auc double")
    assert diagnostics.winner(rows).first()["step"] == 5
    with pytest.raises(ValueError):
        diagnostics.winner(rows.where("isnan(auc)"))


def test_draws_are_exact_or_an_error(spark):
    pool = sampling.indexed_pool(spark.range(12).withColumnRenamed("id", "node"))
    none = spark.createDataFrame([], "a long, b long")
    got = sampling.draw_pairs(spark, pool, pool, none, 60, 1)
    rows = {tuple(r) for r in got.collect()}
    assert len(rows) == 60 and all(a < b for a, b in rows)
    few = {tuple(r) for r in sampling.draw_pairs(spark, pool, pool, none, 10, 1).collect()}
    assert few < rows  # more draws change no earlier one
    with pytest.raises(ValueError, match="more than"):
        sampling.draw_pairs(spark, pool, pool, none, 67, 1)
    known = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12) if (a, b) != (0, 1)], "a long, b long")
    assert [tuple(r) for r in sampling.draw_pairs(spark, pool, pool, known, 1, 1).collect()] == [(0, 1)]
    with pytest.raises(ValueError, match="too few"):
        sampling.draw_pairs(spark, pool, pool, known, 2, 1)


def test_substitution_and_pair_columns(spark):
    d = spark.createDataFrame([("?", "x"), ("m", "y"), (None, "z")], "own string, other string")
    assert [r[0] for r in d.select(S.substituted(F.col("own"), F.col("other"), {"m": "pk", "x": "pk"})).collect()] == ["pk", "pk", None]
    assert cleaning.pair_columns(d, "own", "other").columns == ["own", "other"] and cleaning.pair_columns(d.select("own")).columns == ["own"]


def test_anchors_are_those_of_a_greedy_pass(spark):
    from pairloom.functions.scalars import hash_order

    e, _ = graph_edges(spark, 60, 200)
    rows = e.withColumn("o", hash_order(F.lit("3"), F.lit("anchor"), F.col("a"), F.col("b"))).orderBy("o").collect()
    seen, kept = set(), set()
    for r in rows:
        if not {r["a"], r["b"]} <= seen:
            kept.add((r["a"], r["b"]))
            seen |= {r["a"], r["b"]}
    assert {(r["a"], r["b"]) for r in folds.coverage_anchors(e, 3).collect()} == kept


def pair_score(bits, q, r):
    sim = lambda x, y: len(bits[x] & bits[y]) / len(bits[x] | bits[y]) if bits[x] | bits[y] else 0.0
    return max((sim(q[0], r[0]) + sim(q[1], r[1])) / 2, (sim(q[0], r[1]) + sim(q[1], r[0])) / 2)


def test_top_pair_examples_and_few_shot_map(spark):
    import random

    g = random.Random(12)
    bits = {n: set(g.sample(range(24), 3)) for n in range(40)}
    names = {n: set(g.sample("abcdefghijklmnop", 2)) for n in range(36)}
    pool = sorted({tuple(sorted(g.sample(range(42), 2))) for _ in range(60)})
    queries = sorted({tuple(g.sample(range(42), 2)) for _ in range(25)}) + [(50, 1), (38, 39)]
    prints = spark.createDataFrame([(n, sorted(b)) for n, b in bits.items()], "node long, bits array<int>")
    q, p = spark.createDataFrame(queries, "qa long, qb long"), spark.createDataFrame(pool, "ra long, rb long")
    apart = lambda q, r: not set(q) & set(r)
    best = lambda q, of, k: sorted((-pair_score(bits, q, r), r) for r in of if apart(q, r) and set(r) <= bits.keys())[:k]
    got = {}
    for r in retrieval.top_pair_examples(q, p, prints, 4).collect():
        got.setdefault((r["qa"], r["qb"]), {})[r["place"]] = (-r["score"], (r["ra"], r["rb"]))
    for x in queries:
        want = best(x, pool, 4) if set(x) <= bits.keys() else []
        mine = [got.get(x, {})[i] for i in sorted(got.get(x, {}))]
        assert [r for _, r in mine] == [r for _, r in want] and all(abs(a - b) < 1e-12 for (a, _), (b, _) in zip(mine, want, strict=True))
    entities = spark.createDataFrame([(n, e) for n, es in names.items() for e in sorted(es)], "node long, entity string")
    out = {}
    for r in retrieval.few_shot_map(q, p, entities, prints, 3, 5).collect():
        out.setdefault((r["qa"], r["qb"]), {})[r["place"]] = r
    assert sorted(out) == sorted(queries)
    for x in queries:
        mine = [out[x][i] for i in (1, 2, 3)]
        shares = [r for r in pool if apart(x, r) and any(names.get(a, set()) & names.get(b, set()) for a in x for b in r)]
        if not set(x) <= bits.keys():
            assert all(r["note"] == "no_fp" for r in mine)
            continue
        want = [r for _, r in best(x, shares or pool, 3)]
        assert [(r["ra"], r["rb"]) for r in mine if r["note"] == ""] == want
        assert all(r["note"] == ("padding" if want else "no_valid_candidates") and apart(x, (r["ra"], r["rb"])) for r in mine[len(want) :])
        for r in mine[: len(want)]:
            assert r["shared_QA_CA"] == (sorted(names.get(x[0], set()) & names.get(r["ra"], set())) if shares else [])


def test_runs_prompts_and_saved_scorers(spark, tmp_path):
    from pairloom.operators import runs
    from pairloom.streaming import resume as resumed

    d = str(tmp_path)
    pairs = spark.createDataFrame([("1", "2"), ("3", "4")], "a string, b string")
    model = scoring.scorer("hash_baseline")
    assert resumed.resume(spark, pairs, model, f"{d}/scores", {"model": "x"}).count() == 2
    assert resumed.resume(spark, pairs, model, f"{d}/scores", {"model": "x"}).count() == 2
    with pytest.raises(validate.Invalid):
        resumed.resume(spark, pairs, model, f"{d}/scores", {"model": "y"})
    assert runs.prompt_differences({"method": "A", "model_name": "Llama-1B"}, {"method": "a", "model_name": "llama-3b", "task_name": "t"}) == []
    with pytest.raises(validate.Invalid):
        runs.check_prompt({"task_name": "s"}, {"task_name": "t"})
    with pytest.raises(FileNotFoundError):
        runs.check_inputs(spark, d, ("extract", "clean"), ("extract",))
    with pytest.raises(FileNotFoundError):
        scoring.load_scorer(spark, d)
    scoring.register_module("far_scorer", "no.such.module")
    with pytest.raises(ImportError):
        scoring.scorer("far-scorer")
    with pytest.raises(ValueError):
        scoring.register("hash_baseline")(type("Other", (), {"modality": "mol"}))


def test_percentile_edges_equal_exact_percentiles(spark):
    rows = spark.createDataFrame([(float(i * i % 37),) for i in range(23)] + [(None,)], "v double")
    at = [i / 10 for i in range(11)]
    want = rows.agg(F.percentile("v", F.array(*map(F.lit, at)))).first()[0]
    got = metrics.percentile_edges(rows, "v").first()[0]
    assert all(abs(a - b) <= 1.1e-9 for a, b in zip(got, want, strict=True))
    assert metrics.percentile_edges(rows.limit(1), "v").first()[0] == []
