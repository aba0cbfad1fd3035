"""Search: BM25, exact neighbours, fusion, expansion, gram similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.operators import retrieval as S
from sparquill.operators import vectors
from sparquill.plans.registry import query, rows
from sparquill.sources.tables import table

_TOKENS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+'), lambda x: x <> '')"
_BM25 = f"""
    WITH t AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents),
    l AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM t),
    p AS (SELECT id, dl, term, count(*) AS tf FROM l GROUP BY ALL),
    s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM t),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    c AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
    r AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
          FROM c JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
    bm25 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10)
"""
_NEAR = """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 10)
"""


def tokens():
    return F.split(T.ascii_lower(F.coalesce("text", F.lit(""))), "[^a-z]+")


def bm25_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = docs.agg(F.count("*"), F.avg(F.size(F.filter(tokens(), lambda t: t != "")))).first()
    asked = table(spark, sf_dir, "benchmark")
    return S.bm25(S.postings(docs, "doc_id", tokens(), S.query_terms(asked, tokens())), asked, "item_id", tokens(), size[0], size[1] or 1.0)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e, e, 10, "vec_id", "vec_id", "embedding")


@query("bm25_search", _BM25 + "SELECT query_id, id, score, rank FROM bm25")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_hits(spark, sf_dir)


@query("nearest_vectors", _NEAR + "SELECT query_id, id, score, rank FROM near")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir)


_FUSED = """
    , a AS (SELECT query_id, id, rank FROM near), b AS (
        SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM (
            SELECT x.vec_id AS query_id, y.vec_id AS id, abs(x.vec_id - y.vec_id) AS d FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id) QUALIFY rank <= 10),
    fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
"""


def label_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second channel: vectors of the same label, nearest id first, from a frame of ten before and ten after."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    before, after = Window.partitionBy("label").orderBy("vec_id").rowsBetween(-10, -1), Window.partitionBy("label").orderBy("vec_id").rowsBetween(1, 10)
    near = e.select(F.col("vec_id").alias("query_id"), F.concat(F.collect_list("vec_id").over(before), F.collect_list("vec_id").over(after)).alias("ids"))
    near = near.select("query_id", F.explode("ids").alias("id"))
    return S.top_per(near, ["query_id"], 10, F.abs(F.col("query_id") - F.col("id")), "id")


@query("rank_fusion", _NEAR + _FUSED + "SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused QUALIFY rank <= 10")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuse([neighbours(spark, sf_dir), label_hits(spark, sf_dir)], top=10)


@query(
    "reference_expansion",
    """
    WITH seeds AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000),
    e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
    h AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM seeds)),
    i AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM h))
    SELECT 1 AS query_id, id, 0 AS hop FROM seeds UNION ALL SELECT 1, id, 1 FROM h UNION ALL SELECT 1, id, 2 FROM i
    """,
)
def reference_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c)
    seeds = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").select(F.lit(1).alias("query_id"), name("c", "c_custkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    li = table(spark, sf_dir, "lineitem").select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"))
    return S.expand(seeds, o.unionByName(li), hops=2)


@query(
    "hybrid_search",
    _NEAR + _FUSED
    + """, f AS (SELECT query_id, id, score, false AS expanded FROM fused),
    x AS (SELECT DISTINCT query_id, id + 1 AS id FROM f WHERE id + 1 IN (SELECT vec_id FROM v)),
    u AS (SELECT * FROM f UNION ALL SELECT query_id, id, 0.0, true FROM x WHERE (query_id, id) NOT IN (SELECT query_id, id FROM f))
    SELECT query_id, id, score, expanded, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM u QUALIFY rank <= 25""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    edges = ids.select((F.col("vec_id") - 1).alias("src"), F.col("vec_id").alias("dst"))  # each vector refers to the next
    return S.hybrid(neighbours(spark, sf_dir), label_hits(spark, sf_dir), edges, top=25)


_GRAMS12 = "list_distinct(list_concat([substr(s, i, 1) for i in range(1, length(s) + 1)], [substr(s, i, 2) for i in range(1, length(s))]))"


@query(
    "weighted_shortlist",
    f"""
    WITH w AS (SELECT * FROM (VALUES (1, 'cold gadget'), (2, 'tiny bolt'), (3, 'warm widgets')) t(q, name)),
    a AS (SELECT q, name, {_GRAMS12} AS g FROM (SELECT q, name, replace(name, ' ', '') AS s FROM w)),
    n AS (SELECT DISTINCT p_name FROM part),
    b AS (SELECT p_name, {_GRAMS12} AS g FROM (SELECT p_name, replace(p_name, ' ', '') AS s FROM n)),
    idf AS (SELECT gram, ln(((SELECT count(*) FROM n) + 1.0) / (count(*) + 1)) + 1 AS w FROM (SELECT p_name, unnest(g) AS gram FROM b) GROUP BY gram),
    x AS (SELECT q, name, unnest(g) AS gram FROM a), y AS (SELECT p_name, unnest(g) AS gram FROM b),
    tot AS (SELECT q, sum(coalesce(w, 1.0)) AS total FROM x LEFT JOIN idf USING (gram) GROUP BY q),
    hit AS (SELECT x.q, x.name, y.p_name, sum(coalesce(w, 1.0)) AS hit FROM x JOIN y USING (gram) LEFT JOIN idf USING (gram) GROUP BY ALL),
    s AS (SELECT q, p_name, round(hit / total * CASE WHEN contains(p_name, right(name, 1)) THEN 1 ELSE 0.3 END, 6) AS score FROM hit JOIN tot USING (q))
    SELECT q, p_name, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, length(p_name), p_name) AS INTEGER) AS rank FROM s QUALIFY rank <= 15
    """,
)
def weighted_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rows(spark, "q int, name string", (1, "cold gadget"), (2, "tiny bolt"), (3, "warm widgets"))
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    grams = T.grams12(F.col("p_name"))
    hits = S.gram_matches(asked, names, "q", "p_name", T.grams12(F.col("name")), grams, S.gram_idf(names, grams))
    scored = hits.join(asked, hits["left_id"] == asked["q"]).withColumn("p_name", F.col("right_id"))
    scored = scored.select("q", "p_name", F.round(T.tail_rule(F.col("hit") / F.col("total"), F.col("name"), F.col("p_name")), 6).alias("score")).where("score > 0")
    return S.top_per(scored, ["q"], 15, F.desc("score"), F.length("p_name"), "p_name")


_SPECS = "SELECT DISTINCT p_name || ' ' || p_type AS name FROM part"


@query(
    "weighted_names",
    f"""
    WITH n AS ({_SPECS}), g AS (SELECT name, {_GRAMS12} AS g FROM (SELECT name, regexp_replace(name, '[ 0-9/().-]', '', 'g') AS s FROM n)),
    e AS (SELECT name, unnest(g) AS gram FROM g),
    idf AS (SELECT gram, ln(((SELECT count(*) FROM n) + 1.0) / (count(*) + 1)) + 1 AS w FROM e GROUP BY gram),
    tot AS (SELECT name, sum(w) AS total FROM e JOIN idf USING (gram) GROUP BY name),
    hit AS (SELECT x.name AS wanted, y.name AS found, sum(w) AS hit FROM e x JOIN e y USING (gram) JOIN idf USING (gram) GROUP BY ALL)
    SELECT wanted, found, round(hit / total, 6) AS score FROM hit JOIN tot ON tot.name = wanted WHERE hit >= 0.8 * total * (1 - 1e-9)
    """,
)
def weighted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts against each other: those that cover at least 0.8 of a name's gram weight."""
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    grams = T.grams12(F.col("name"))
    met = S.weighted_matches(names, names, "name", "name", grams, grams, S.gram_idf(names, grams), 0.8)
    return met.select(F.col("left_id").alias("wanted"), F.col("right_id").alias("found"), F.round(F.col("hit") / F.col("total"), 6).alias("score"))


@query(
    "auto_select",
    _NEAR + """, m AS (SELECT query_id, max(CASE WHEN rank = 1 THEN id END) AS id, max(CASE WHEN rank = 1 THEN score END) AS score, max(CASE WHEN rank = 2 THEN score END) AS runner_up FROM near GROUP BY 1)
    SELECT query_id, id, score, runner_up, score >= 0.5 AND round(score - runner_up, 9) >= 0.02 AS auto FROM m""",
)
def auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.auto_select(neighbours(spark, sf_dir), ["query_id"], "score", 0.5, 0.02).select("query_id", "id", "score", "runner_up", "auto")


@query(
    "term_scores",
    """
    SELECT p_partkey, CAST(CASE WHEN contains(p_name, 'cold widget') THEN 5 ELSE 0 END + CASE WHEN contains(p_name, 'cold') THEN 1.2 ELSE 0 END
           + CASE WHEN contains(p_name, 'd') THEN 1 + 0.2 * least((length(p_name) - length(replace(p_name, 'd', ''))), 3) ELSE 0 END AS DOUBLE) AS score
    FROM part
    """,
)
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.term_score(F.col("p_name"), "cold widget", ["cold", "d"])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 9).alias("score"))


@query(
    "leakage_check",
    """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id AS eval_id, b.label AS grp, b.vec_id AS train_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label = 0 AND b.label <> 0),
    m AS (SELECT DISTINCT ON (eval_id, grp) eval_id, grp, train_id, score FROM p ORDER BY eval_id, grp, score DESC, train_id)
    SELECT eval_id, grp, train_id, score, score > 0.3 AS leaked FROM m
    """,
)
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best match of every evaluation vector in each training group; matches above the threshold (strictly) leak."""
    e = table(spark, sf_dir, "embeddings")
    best = vectors.nearest(e.where("label = 0"), e.where("label <> 0"), 1, "vec_id", "vec_id", "embedding", group="label")
    return best.select(F.col("query_id").alias("eval_id"), F.col("label").alias("grp"), F.col("id").alias("train_id"), "score", (F.col("score") > 0.3).alias("leaked"))


@query(
    "similarity_spread",
    _NEAR + "SELECT round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, max(score) AS most, count(*) FILTER (WHERE score > 0.5) AS above FROM near WHERE rank = 1",
)
def similarity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = neighbours(spark, sf_dir).where("rank = 1")
    q = F.percentile("score", F.array(F.lit(0.5), F.lit(0.95)))
    return best.agg(F.round(q[0], 6).alias("median"), F.round(q[1], 6).alias("p95"), F.max("score").alias("most"), F.count_if(F.col("score") > 0.5).alias("above"))


@query(
    "gram_similarity",
    """
    WITH t AS (SELECT a.p_partkey AS x, b.p_partkey AS y, replace(replace(a.p_name, ' ', ''), 'x', '') AS s, replace(replace(b.p_name, ' ', ''), 'x', '') AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    g AS (SELECT x, y, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, CAST(i AS INT), 2))) AS a, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS INT), 2))) AS b FROM t)
    SELECT x, y, round(len(list_intersect(a, b)) / len(a), 6) AS coverage, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g
    """,
)
def gram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name and the next one's."""
    p = table(spark, sf_dir, "part")
    both = p.selectExpr("p_partkey AS x", "p_name AS s").join(p.selectExpr("p_partkey - 1 AS x", "p_partkey AS y", "p_name AS t"), "x")
    a, b = T.grams(F.col("s")), T.grams(F.col("t"))
    return both.select("x", "y", F.round(T.coverage(a, b), 6).alias("coverage"), F.round(T.jaccard(a, b), 6).alias("jaccard"))


@query("cell_search_recall", "SELECT CAST(count(*) AS BIGINT) AS queries, true AS enough FROM embeddings")
def cell_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of cells against exact neighbours: at least 0.9 of the ten best are found."""
    e = table(spark, sf_dir, "embeddings")
    near = vectors.nearest_in_cells(e, e, 10, "vec_id", "vec_id", "embedding", cells=16, probes=12).select("query_id", "id", F.lit(1).alias("hit"))
    both = neighbours(spark, sf_dir).select("query_id", "id").join(near, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


@query("graph_search_recall")
def graph_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as queries in the layered graphs: the share of the ten exact neighbours that is found, and of the vectors that a query is compared with."""
    e = table(spark, sf_dir, "embeddings")
    found = vectors.graph_search(vectors.graph_index(e, "vec_id", "embedding"), e, 10, "vec_id", "embedding", width=16).select("query_id", "id", "compared")
    both = neighbours(spark, sf_dir).select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = both.agg(F.countDistinct("query_id").alias("queries"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))
    asked = found.groupBy("query_id").agg(F.first("compared").alias("compared")).agg(F.sum("compared").alias("compared"), F.count("*").alias("n"))
    return recall.join(F.broadcast(asked)).select("queries", "recall", F.round(F.col("compared") / F.col("n") / F.col("queries"), 4).alias("share"))  # one row each
