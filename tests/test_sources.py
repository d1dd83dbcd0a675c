"""XML, CSV, JSON and manifests."""

import json

import pytest

from pairloom.operators import folds
from pairloom.schemas import EDGES
from pairloom.sources import tables, xml

DOC = """<?xml version="1.0"?><root xmlns="http://x.org">
<drug type="small molecule"><drugbank-id primary="true">D1</drugbank-id><drugbank-id>OLD1</drugbank-id><name>One</name><groups><group>withdrawn</group><group>approved</group></groups>
<calculated-properties><property><kind>SMILES</kind><value>CCO</value></property></calculated-properties>
<drug-interactions><drug-interaction><drugbank-id>D2</drugbank-id><name>Two</name><description>One raises Two.</description></drug-interaction><drug-interaction><drugbank-id>D3</drugbank-id><name>N</name><description> </description></drug-interaction></drug-interactions>
<enzymes><enzyme><id>E1</id><name>Enz</name><organism>Humans</organism><actions><action>inhibitor</action><action>substrate</action></actions></enzyme><enzyme><id>E2</id><name>Bare</name><organism>Humans</organism><actions/></enzyme></enzymes>
<pathways><pathway><smpdb-id>S1</smpdb-id><name>Path</name><drugs><drug><drugbank-id>D9</drugbank-id><name>nested</name></drug></drugs></pathway></pathways></drug>
<drug type="biotech"><drugbank-id primary="true">D2</drugbank-id><name>Two</name><drug-interactions><drug-interaction><drugbank-id>D1</drugbank-id><name>One</name><description>reversed</description></drug-interaction></drug-interactions></drug>
<drug type="biotech"><drugbank-id>NOPRIMARY</drugbank-id><name>None</name></drug></root>"""


def test_xml_tables_and_subset(spark, tmp_path):
    p = tmp_path / "x.xml"
    p.write_text(DOC)
    t = xml.parse(spark, str(p))
    assert [tuple(r) for r in t.drugs.orderBy("drugbank_id").collect()] == [("D1", "One", "small molecule", "CCO", "approved;withdrawn"), ("D2", "Two", "biotech", None, "")]
    assert [(r["drug_a_id"], r["drug_b_id"], r["description"]) for r in t.edges.collect()] == [("D1", "D2", "One raises Two.")]
    assert [(r["enzyme_id"], r["action"]) for r in t.enzymes.orderBy("item_pos", "action_pos").collect()] == [("E1", "inhibitor"), ("E1", "substrate"), ("E2", "")]
    assert t.pathways.first()["pathway_id"] == "S1" and t.targets.isEmpty()
    xml.write_subset(spark, str(p), spark.createDataFrame([("D1",)], "drugbank_id string"), str(tmp_path / "out"))
    again = xml.parse(spark, str(tmp_path / "out"))
    assert [r["drugbank_id"] for r in again.drugs.collect()] == ["D1"] and again.edges.isEmpty() and again.enzymes.count() == 3


def test_tables_round_trip(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([("a", "b", 'text, with "quotes"', "t")], EDGES)
    tables.write_tables({"edges": df}, d)
    assert tuple(tables.read_table(spark, d, "edges", EDGES).first()) == tuple(df.first())
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, d, "nothing", EDGES)
    f = spark.createDataFrame([(1, 2, "train"), (1, 3, "test_s1")], "a long, b long, split string")
    g = spark.createDataFrame([(1, "G1")], "node long, grp string")
    tables.write_folds(f, g, {"seed": 42}, d)
    back, _, m = tables.read_folds(spark, d)
    assert back.count() == 2 and m == {"seed": 42, "n_pairs": {"train": 1, "test_s1": 1}, "protocol": "legacy"}
    assert folds.resolve_protocol(m["protocol"])["drug_ratio"] == 1.5


def test_json(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"a": "x", "b": "y"}')
    assert tables.load_text_map(spark, str(p)).count() == 2
    for bad in ('{"a": "x", "a": "y"}', '{"a": " "}', "{}", "[1]"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            tables.load_text_map(spark, str(p))
    p.write_text('{\n  "a": "x",\n  "b": "y"\n}')
    assert tables.load_text_map(spark, str(p)).count() == 2
    for told in ({}, {"v": [1, {"w": None}]}):
        tables.write_json(told, str(tmp_path / "told.json"), spark)
        assert tables.read_json(spark, str(tmp_path / "told.json")) == told
    assert tables.read_json(spark, str(tmp_path / "none.json")) is None
    tables.write_json({"v": 1}, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == {"v": 1}
    with pytest.raises(ValueError):
        tables.write_json({"v": float("nan")}, str(tmp_path / "o.json"))


def test_cached_negatives_are_all_or_none(spark, tmp_path):
    from pairloom.sources import tables as T

    one = spark.createDataFrame([("x", "y")], "a string, b string")
    names = [f"{k}_s{i}" for i in range(3) for k in ("val", "test")]
    for n in names[:-1] + ["epoch_0", "epoch_2"]:
        one.write.parquet(f"{tmp_path}/{n}.parquet")
    static, epochs = T.cached_negatives(spark, str(tmp_path))
    assert static is None and len(epochs) == 1
    one.write.parquet(f"{tmp_path}/{names[-1]}.parquet")
    static, _ = T.cached_negatives(spark, str(tmp_path))
    assert sorted(r["split"] for r in static.collect()) == sorted(names)


def test_first_place_that_exists(spark, tmp_path):
    import pytest

    from pairloom.sources import tables as T

    spark.range(3).write.parquet(f"{tmp_path}/b.parquet")
    got = T.find_one(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.parquet"])
    assert got.endswith("b.parquet") and T.read_any(spark, got).count() == 3
    with pytest.raises(FileNotFoundError, match="a.csv"):
        T.find_one(spark, [f"{tmp_path}/a.csv"])


def test_large_xml_is_written_compressed(spark, tmp_path):
    import glob

    from pairloom.plans import sources_scoring as SS
    from pairloom.plans.registry import Tables

    path = SS.as_xml(Tables(spark, "/root/testdata/sf0.001"))
    assert glob.glob(f"{path}/part-*.xml.gz") and not glob.glob(f"{path}/part-*.xml")
    xml.write_subset(spark, path, spark.createDataFrame([("P1",), ("P2",)], "drugbank_id string"), str(tmp_path / "few"), compression="gzip")
    assert glob.glob(f"{tmp_path}/few/part-*.gz") and xml.parse(spark, str(tmp_path / "few")).drugs.count() == 2
