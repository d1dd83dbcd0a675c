"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from pairloom.llm import ann, decontam, licenses, mixing, neardup, quality, secrets, sharding, tokens, urls
from pairloom.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, score string, shard string, weight string, n_tokens string, spans string"
LONG = "alpha beta gamma delta " * 20000


def odd_docs(spark):
    x = ("en", "s", "c", "c", "c", "c", "c")
    rows = [(1, None, *x), (2, "", *x), (3, LONG, *x), (4, "one two three four five six", *x), (4, "one two three four five six", *x), (None, "one two three four five six", *x), (5, " \n\t ", None, None, *x[2:]), (6, "éü\U0001f600 x", *x)]
    return spark.createDataFrame(rows, SCHEMA)


OPS = {
    "secrets": secrets.secret_scan,
    "shards": sharding.shard_table,
    "tokens": lambda d: tokens.token_counts(d, vocabulary_path()),
    "licenses": licenses.license_scan,
    "neardup": lambda d: neardup.near_duplicates(d, 3, 85),
    "quality": lambda d: quality.score_documents(d, quality.Network()),
    "mix": lambda d: mixing.mix(d.withColumn("n", mixing.tokens_of(F.col("text"))), {"source": 0.5, "lang": {"en": 1.0}}, tokens="n"),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_keep_one_row_each(spark, name):
    docs = odd_docs(spark)
    out = OPS[name](docs).collect()
    assert len(out) == docs.count()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in docs.collect())


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](odd_docs(spark).limit(0)).collect() == []


def test_secret_of_null_is_empty(spark):
    r = {x["doc_id"]: x for x in secrets.secret_scan(odd_docs(spark)).collect()}
    assert r[1]["spans"] == "" and r[1]["base_sha256"] == r[2]["base_sha256"] and r[1]["n_hex"] == 0


def test_near_duplicates_of_odd_rows(spark):
    out = neardup.near_duplicates(odd_docs(spark), 3, 85).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    null = next(r for r in out if r["doc_id"] is None)
    assert null["component_id"] is None and null["kept"]
    assert by[4]["component_id"] == 4 and by[1]["n_shingles"] == 0 and by[5]["n_shingles"] == 0 and by[5]["kept"]


def test_decontamination_of_odd_rows(spark):
    item = "a passage of a benchmark that is long enough to be found anywhere in a text"
    bench = spark.createDataFrame([(1, item), (2, None), (None, "keyless item of some length that is ignored"), (3, ""), (4, "ab")], "item_id long, text string")
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(9, "before. " + item + " after"), (10, item[:-3])], "doc_id long, text string"), allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {(9, 1), (10, 1)} <= got and all(i != 1 for d, i in got if d not in (9, 10))
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []
    assert decontam.contaminated(docs.limit(0), bench).collect() == []


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (2, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(v).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 1.0), (0, 2, 0.5), (0, 20, 0.0), (20, 2, 0.5), (20, 0, 0.0), (20, 1, 0.0)]
    assert ann.nearest(v.limit(0)).collect() == []


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "http://A.NET/x?y"), (5, "http://A.NET/x?y"), (None, "ftp://b.example.org/fr/1#z")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None)], "page_id long, bad int")
    out = urls.url_filter(pages, labels).collect()
    assert len(out) == 7
    by = {r["page_id"]: r for r in out}
    assert (by[1]["host"], by[1]["path"]) == ("", "") and by[5]["rule"] == "net/" and by[None]["rule"] == "org/fr/" and by[5]["host"] == "a.net"
    assert urls.url_filter(pages.limit(0), labels).collect() == []
    assert len(urls.url_filter(pages, labels.limit(0)).collect()) == 7


def test_quality_without_labels(spark):
    docs = odd_docs(spark)
    net = quality.fit_quality(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(docs, net).collect())


def test_mixture_beyond_the_driver_bound(spark):
    docs = spark.createDataFrame([(i, f"s{i % 5}", f"l{i % 3}", 1 + i % 7) for i in range(600)], "doc_id long, source string, lang string, n_tokens long")
    dims = {"source": 0.5, "lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25}}
    near = {r["doc_id"]: r for r in mixing.mix(docs, dims).collect()}
    far = {r["doc_id"]: r for r in mixing.mix(docs, dims, driver_cells=0).collect()}
    for k, r in near.items():
        assert abs(r["weight"] - far[k]["weight"]) < 1e-5 and abs(r["prob"] - far[k]["prob"]) < 1e-5


def test_sent_objects_need_no_package_in_the_workers(tmp_path):
    """What operators broadcast is read by a process that cannot import this package."""
    import subprocess
    import sys

    import numpy as np
    from pyspark import cloudpickle

    from pairloom.llm import ann, decontam

    (tmp_path / "thing").write_bytes(cloudpickle.dumps((ann.Curves(np.eye(32)), decontam.Index([(0, b"a passage of some forty bytes that is long")], 0.2))))
    code = "import pickle, sys; c, i = pickle.load(open('thing', 'rb')); print(c.keys(__import__('numpy').eye(32)).shape[0], len(i.groups), 'pairloom' in sys.modules)"
    got = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert got.stdout.split() == ["32", "1", "False"], got.stderr[-500:]
