"""Queries of the numbered operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import chat, clustering, credentials, exact_dedup, lexical, licenses, lm, mixing, near_dedup, packing, quality, search, substring_dedup
from sparquill.llm.common import documents


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), "text")
    return search.search(search.build_index(docs), asked, k=10)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def held_out(every: int, rest: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % every == rest


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir), held_out(7, 2))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), "draws"
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(told.unionByName(planted)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(5, 0))
    return quality.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op5_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(documents(spark, sf_dir), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(documents(spark, sf_dir))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, seed=2).drop("contenders")


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds as one chain of tables: centroids c0 to c5 and, from each, the assignment a0 to a5."""
    parts = [
        f"""v AS (
            SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, x AS m
            FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k})
        )"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
                SELECT vec_id, c, d FROM (
                    SELECT vec_id, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS d FROM v CROSS JOIN c{r}
                ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
            )"""
        )
        if r < rounds:
            parts.append(
                f"""s{r} AS (
                    SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) CROSS JOIN range(1, 65) t(i) GROUP BY c, i
                ), n{r} AS (
                    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c
                ), c{r + 1} AS MATERIALIZED (
                    SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN n{r} n USING (c)
                )"""
            )
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)
    """


QUERIES = {
    "op11_ranked_search": op11_ranked_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_centroid_clustering": op13_centroid_clustering,
    "op8_license_scan": op8_license_scan,
    "op9_topk_search": op9_topk_search,
    "op3_chat_formatting": op3_chat_formatting,
    "op7_substring_dedup": op7_substring_dedup,
    "op1_lm_scoring": op1_lm_scoring,
    "op5_nnls_packing": op5_nnls_packing,
    "op2_source_mixing": op2_source_mixing,
    "op4_quality_classifier": op4_quality_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = {
    "op11_ranked_search": rf"""
        WITH t AS (
            SELECT doc_id, unnest({_TERMS}) AS term FROM documents
        ), p AS (
            SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
        ), d AS (
            SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
        ), g AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN g GROUP BY term, docs
        ), q AS (
            SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id) CROSS JOIN g GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_centroid_clustering": _kmeans_sql(),
    "op9_topk_search": r"""
        WITH w AS (
            SELECT doc_id, unnest(list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term
            FROM documents
        ), p AS (
            SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL
        ), l AS (
            SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id
        ), g AS (
            SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM l) / (SELECT count(*) FROM documents) AS mean
        ), d AS (
            SELECT term, count(*) AS df FROM p GROUP BY term
        ), s AS (
            SELECT q.doc_id AS query_id, p.doc_id,
                   round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
            FROM p q JOIN p ON p.term = q.term JOIN d ON d.term = p.term JOIN l ON l.doc_id = p.doc_id CROSS JOIN g
            WHERE q.doc_id % 100 = 0 GROUP BY ALL
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op3_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
               CAST(sum(3 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]')) + 6) AS BIGINT)
                   AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op6_minhash_near_dedup": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
            FROM t
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), e AS (
            SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)
        ), u AS (
            SELECT x, y FROM e UNION ALL SELECT y, x FROM e
        ), r AS (
            SELECT doc_id AS k, doc_id AS m FROM documents UNION SELECT r.k, u.y FROM r JOIN u ON u.x = r.m
        ), c AS (
            SELECT k, min(m) AS component_id FROM r GROUP BY k
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.k = d.doc_id
    """,
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM n
    """,
}
