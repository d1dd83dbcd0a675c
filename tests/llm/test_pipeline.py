"""The pipeline end to end, each stage against what it should do to planted cases."""

import random

from test_brute_force import WORDS, brute_components, texts

import corpus_pipeline


def test_stages(spark, tmp_path):
    g = random.Random(21)
    items = texts(10, 22, 25, 50)
    good = texts(500, 23, 40, 200)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(good)]
    junk = [(1000 + i, " | ".join(g.choice(WORDS) + "$$$" for _ in range(100)), "en", "s0", 900) for i in range(200)]
    copies = [(2000 + i, good[i], "en", "s1", 1) for i in range(30)]
    leaks = [(3000 + i, good[i] + " " + items[i % 10] + " " + good[i + 1], "en", "s2", 1) for i in range(100, 130)]
    d = str(tmp_path)
    spark.createDataFrame(rows + junk + copies + leaks, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}.parquet")
        docs = spark.read.parquet(f"{d}/stage{k}.parquet")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    quality, near, clean, mixed, shards = kept
    assert len({r[0] for r in junk} & quality) <= 4 and len({r[0] for r in rows} - quality) <= 4
    text = {r[0]: r[1] for r in rows + junk + copies + leaks}
    want = brute_components([(i, text[i]) for i in sorted(quality)], 5, 80)
    assert near == {i for i, (_, c) in want.items() if c == i}
    assert clean == near - {r[0] for r in leaks}
    assert mixed < clean and 0.3 < len(mixed) / len(clean) < 0.7
    assert shards == mixed
    final = corpus_pipeline.run(spark, d).toPandas()
    assert set(final.doc_id) == shards and set(final.columns) >= {"doc_id", "size", "shard", "slot"}


ITEM = "a passage of a benchmark that is long enough to be found anywhere in a text of any length"
ODD = [
    (1, None, "en", "s0"), (2, "", "en", None), (3, " \n\t ", None, "s0"), (None, texts(1, 31, 40, 60)[0], "en", "s0"), (4, texts(1, 32, 40, 60)[0], "en", "s1"),
    (4, texts(1, 32, 40, 60)[0], "en", "s1"), (5, texts(1, 33, 30000, 30000)[0], "de", "s1"), (None, "see " + ITEM + " here", "en", "s0"), (6, "and " + ITEM.upper() + " there", "en", "s0"), (7, "é\U0001f600", "fr", "s2"),
]


def odd_folder(spark, d, rows):
    clash = [(*r, "own weight", "own prob", "own score", 3) for r in rows]
    spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, weight string, prob string, score string, n_shingles int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(4, None, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return spark.read.parquet(f"{d}/documents.parquet")


def test_each_stage_on_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_folder(spark, str(tmp_path), ODD)
    want = sorted(map(str, docs.collect()))
    good, near, clean, mixed, shards = (stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES)
    for out in (good, near, clean, mixed):
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert set(map(str, out.collect())) <= set(want)
    assert sorted(map(str, good.collect())) == want  # without labels nothing is rejected
    assert sorted(map(str, near.collect())) == want  # rows of one id stay together
    assert [r["doc_id"] for r in clean.collect() if ITEM in (r["text"] or "").lower()] == [] and clean.count() == len(ODD) - 2
    assert shards.count() == len(ODD)


def test_stages_and_run_on_empty_tables(spark, tmp_path):
    docs = odd_folder(spark, str(tmp_path), ODD[:1]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
