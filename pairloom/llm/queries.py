"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, decontam, licenses, mixing, neardup, quality, search, secrets, sharding, tokens, urls, wrappers
from .common import materialize, read_table

#: Where the vocabulary lies; any path to a file of the same form may be given instead.
VOCABULARY = "byte_bpe_50k.json"
#: Targets of the mixture: given weights of the languages; observed shares of sources and topics raised to these powers.
MIXTURE = {"source": 0.7, "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}, "topic": 0.8}
SHARDS = 16
ACCEPT = 0.7


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def mixture_rows(docs: DataFrame) -> DataFrame:
    """doc_id, dims and tokens of every document."""
    return docs.select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.tokens_of(F.col("text")).alias("n_tokens"))


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = materialize(mixture_rows(read_table(spark, sf_dir, "documents")), "mixture")
    return mixing.mix(slim, MIXTURE)


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf_dir, "documents"), SHARDS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op6_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return urls.url_filter(read_table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op10_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, net)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_wrapper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = [
        op1_secret_scan, op2_hilbert_neighbours, op3_raked_mixture, op4_hash_tree_shards, op5_token_counts, op6_setsketch_dedup,
        op7_license_templates, op8_decontamination, op9_url_templates, op10_byte_convnet,
        op11_ranked_search, op12_centroid_clusters, op13_wrapper_texts,
    ]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL by brute force: all pairs by common shingles, all inner products, all distances of every round."""
    return {
        "op2_hilbert_neighbours": NEIGHBOURS_SQL, "op6_setsketch_dedup": NEAR_DUPLICATES_SQL, "op11_ranked_search": RANKED_SQL,
        "op12_centroid_clusters": clusters_sql(), "op13_wrapper_texts": ARTICLES_SQL,
    }


def clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """All distances of every round; a round is three views."""
    views = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS HUGEINT)) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM
           (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {clusters}))""",
    ]
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        views += [
            f"d{k} AS (SELECT v.r, c.c, {far} AS d FROM v CROSS JOIN c{k} c)",
            f"a{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM d{k}) WHERE n = 1)",
        ]
        if k < rounds:
            views += [
                f"""m{k} AS (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS HUGEINT) AS x FROM (SELECT a.c, g.i, CAST(sum(v.e[g.i]) AS HUGEINT) AS s, count(*) AS n
                FROM a{k} a JOIN v ON v.r = a.r CROSS JOIN (SELECT unnest(range(1, 65)) AS i) g GROUP BY 1, 2))""",
                f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM m{k} GROUP BY c) m ON m.c = c.c)",
            ]
    return f"""WITH {", ".join(views)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"""


NEIGHBOURS_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""

RANKED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY 1, 2),
c AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
m AS (SELECT r, doc_id, CAST(50 + (50 * len(ws) * n) // l AS BIGINT) AS m FROM d, c),
s AS (SELECT q.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
      FROM q JOIN w ON w.term = q.term JOIN t ON t.term = q.term JOIN m ON m.r = t.r GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM
  (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

#: The pages of the given tables mark their main text as an article of headings and paragraphs, which the operator is not told.
ARTICLES_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM b),
t AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
