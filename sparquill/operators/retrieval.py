"""Retrieval: BM25 over postings, rank fusion, expansion along references, gram similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.operators.relational import first_per, small, top_per
from sparquill.sources.scratch import written

K1, B, RRF_K = 1.5, 0.75, 60


# ---- BM25


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(term): the distinct words of all queries."""
    return queries.select(F.explode(F.filter(tokens, lambda t: t != "")).alias("term")).distinct()


def postings(docs: DataFrame, id_col: str, tokens: Column, terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl): one row per distinct term of a document; with ``terms`` only theirs, so that other words are never shuffled."""
    words = docs.select(F.col(id_col).alias("id"), F.filter(tokens, lambda t: t != "").alias("_t"))
    each = words.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    each = each if terms is None else each.join(small(terms), "term", "left_semi")
    return each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, queries: DataFrame, query_id: str, tokens: Column, n_docs: int, mean_length: float, k: int | None = 10) -> DataFrame:
    """(query_id, id, score[, rank]): the documents of ``postings`` for each query; repeated query words count each.

    Postings meet queries by an equi-join on the term, scores are partial sums per (query, document). Scores have 6 places;
    ties go to the lesser id. ``k`` None returns all documents with a common term. Else frequent terms are kept out of the
    join: the k-th best sum over a query's rarer half of terms bounds its k-th score from below, the terms that all
    together can't add half of that find no candidates, and candidates that can't reach the bound with them are not scored.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.filter(tokens, lambda t: t != "")).alias("term"))
    wanted = wanted.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    index = written(index, "postings")  # read for the frequencies and for the hits
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_length))
    stats = index.groupBy("term").agg(F.count("*").alias("df"), F.max(impact).alias("most"))
    weighted = wanted.join(stats, "term").withColumn("w", F.col("qtf") * F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def summed(terms: DataFrame, name: str) -> DataFrame:
        return index.join(small(terms.select("query_id", "term", "w")), "term").groupBy("query_id", "id").agg(F.sum(F.col("w") * impact).alias(name))

    if k is None:
        return summed(weighted, "score").withColumn("score", F.round("score", 6))
    weighted = written(weighted, "weighted")
    by_df = Window.partitionBy("query_id").orderBy("df", "term")
    rare = summed(weighted.withColumn("place", F.percent_rank().over(by_df)).where("place <= 0.5"), "part")
    kth = rare.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))).where(F.col("place") == k)
    upto = Window.partitionBy("query_id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = weighted.withColumn("bound", F.sum(F.col("w") * F.col("most")).over(upto)).join(kth.select("query_id", F.col("part").alias("least")), "query_id", "left")
    bounded = written(bounded.withColumn("least", F.coalesce("least", F.lit(0.0))), "bounded")
    joined = F.col("bound") >= 0.5 * F.col("least")
    rest = bounded.groupBy("query_id").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(~joined, F.col("bound"))), F.lit(0.0)).alias("rest"))
    # a bound and a score are sums of the same doubles in another order, so the bound gets a millionth of room
    near = summed(bounded.where(joined), "part").join(small(rest), "query_id").where(F.col("part") + F.col("rest") + 1e-6 >= F.col("least")).select("query_id", "id")
    scored = near.join(index, "id").join(small(weighted.select("query_id", "term", "w")), ["query_id", "term"])
    scored = scored.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * impact), 6).alias("score"))
    return top_per(scored, ["query_id"], k, F.desc("score"), "id")


# ---- fusion and expansion


def fuse(channels: list[DataFrame], k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists: sum of 1 / (k + rank), 6 places; ties to the lesser id."""
    both = reduce(DataFrame.unionByName, [c.select("query_id", "id", "rank") for c in channels])
    scored = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return top_per(scored, ["query_id"], top or (1 << 30), F.desc("score"), "id")


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, id, hop): seeds at hop 0 and what they refer to, step by step, each once at its least hop.

    ``edges`` is (src, dst). A hop is one equi-join and one anti-join.
    """
    seen = seeds.select("query_id", "id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(edges, front["id"] == edges["src"]).select("query_id", F.col("dst").alias("id")).distinct()
        front = step.join(seen, ["query_id", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def hybrid(sparse: DataFrame, dense: DataFrame, edges: DataFrame | None = None, top: int = 10, rerank: Column | None = None) -> DataFrame:
    """Fused lists of two channels, expanded one hop (score 0 for what is added), reranked by a column if given, cut to ``top``."""
    fused = fuse([sparse, dense]).drop("rank").withColumn("expanded", F.lit(False))
    if edges is not None:
        more = expand(fused, edges).where("hop > 0").select("query_id", "id", F.lit(0.0).alias("score"), F.lit(True).alias("expanded"))
        fused = fused.unionByName(more)
    return top_per(fused, ["query_id"], top, F.desc("score" if rerank is None else rerank), "id")


# ---- gram similarity


def gram_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_grams: Column, right_grams: Column, weights: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, hit, total): shared and own gram weight of every pair that shares a gram, by an equi-join on grams.

    ``weights`` is (gram, w); without it each gram weighs 1. A gram without weight weighs 1.
    """
    a = left.select(F.col(left_id).alias("left_id"), F.explode(F.array_distinct(left_grams)).alias("gram"))
    b = right.select(F.col(right_id).alias("right_id"), F.explode(F.array_distinct(right_grams)).alias("gram"))
    a = a.withColumn("w", F.lit(1.0)) if weights is None else a.join(weights, "gram", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    total = a.groupBy("left_id").agg(F.sum("w").alias("total"))
    hits = a.join(b, "gram").groupBy("left_id", "right_id").agg(F.sum("w").alias("hit"))
    return hits.join(total, "left_id")


def prefix_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_grams: Column, right_grams: Column, weights: DataFrame, least: float, reach: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (left_id, right_id, total) of ``weighted_matches``, with the written grams of both sides.

    A left row's grams are put in order of how rarely the right side has them. Grams at the end that together weigh less
    than ``least`` of the total can't make a match alone, so only those before them, the row's prefix, look for partners,
    and only their postings are shuffled. What a pair shares in the prefix and all that lies beyond it bound its hit.
    With ``reach`` under 1 the prefix goes on until only that share of the threshold lies beyond: more postings, but a
    candidate must then share enough weight of rare grams, not just one.
    """
    a = left.select(F.col(left_id).alias("left_id"), F.array_distinct(left_grams).alias("grams"))
    b = written(right.select(F.col(right_id).alias("right_id"), F.array_distinct(right_grams).alias("grams")), "right_grams")
    posted = b.select("right_id", F.explode("grams").alias("gram"))
    often = posted.groupBy("gram").agg(F.count("*").alias("df"))
    each = a.select("left_id", F.explode("grams").alias("gram")).join(weights, "gram", "left").join(often, "gram", "left")
    each = each.select("left_id", "gram", F.coalesce("w", F.lit(1.0)).alias("w"), F.coalesce("df", F.lit(0)).alias("df"))
    from_here = Window.partitionBy("left_id").orderBy("df", "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    each = each.withColumn("rest", F.sum("w").over(from_here)).withColumn("total", F.sum("w").over(Window.partitionBy("left_id")))
    each = written(each, "left_grams")
    prefix = each.where(F.col("rest") >= reach * _need(least))
    beyond = prefix.groupBy("left_id").agg(F.min(F.col("rest") - F.col("w")).alias("beyond"))
    met = posted.join(small(prefix.where("df > 0")), "gram").groupBy("left_id", "right_id").agg(F.sum("w").alias("shared"), F.first("total").alias("total"))
    return met.join(small(beyond), "left_id").where(F.col("shared") + F.col("beyond") >= _need(least)).select("left_id", "right_id", "total"), each, b


def _need(least: float) -> Column:
    """What a hit must weigh; sums of doubles in another order may be off by their last places."""
    return F.lit(least) * F.col("total") * (1 - 1e-9)


def weighted_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_grams: Column, right_grams: Column, weights: DataFrame, least: float, reach: float = 0.6) -> DataFrame:
    """(left_id, right_id, hit, total): the pairs of ``gram_matches`` with hit >= ``least`` * total (0 < least <= 1), all of them and none else.

    Candidates come from a prefix filter with weight bounds (``prefix_candidates``) and are compared with whole gram sets.
    Ids are unique on their side; rows with a null id or without grams match nothing; a gram without weight weighs 1.
    """
    candidates, each, b = prefix_candidates(left, right, left_id, right_id, left_grams, right_grams, weights, least, reach)
    weighed = each.groupBy("left_id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("weights"))
    pairs = candidates.join(weighed, "left_id").join(b, "right_id")
    hit = F.aggregate(F.array_intersect(F.map_keys("weights"), "grams"), F.lit(0.0), lambda acc, g: acc + F.element_at("weights", g))
    return pairs.select("left_id", "right_id", hit.alias("hit"), "total").where(F.col("hit") >= _need(least))


def gram_idf(names: DataFrame, grams: Column) -> DataFrame:
    """(gram, w): ln((N + 1) / (df + 1)) + 1 over all names."""
    each = names.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    n = names.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return each.join(F.broadcast(n)).select("gram", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"))  # one row is broadcast


def exact_else_fuzzy(exact: DataFrame, fuzzy: DataFrame, keys: list[str]) -> DataFrame:
    """Exact matches, and fuzzy ones only for keys without any."""
    return exact.withColumn("match", F.lit("exact")).unionByName(fuzzy.join(exact.select(*keys).distinct(), keys, "left_anti").withColumn("match", F.lit("fuzzy")))


def auto_select(ranked: DataFrame, keys: list[str], score: str, least: float = 0.86, margin: float = 0.08) -> DataFrame:
    """The best candidate of each key with ``runner_up`` and ``auto``: good enough and clear of the next one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "id")
    best = ranked.withColumn("_n", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w)).where("_n = 1").drop("_n")
    clear = F.col("runner_up").isNull() | (F.round(F.col(score) - F.col("runner_up"), 9) >= margin)
    return best.withColumn("auto", (F.col(score) >= least) & clear)


def exemplars(cases: DataFrame, edition: str, similarity: Column, least: float = 0.12, k: int = 5) -> DataFrame:
    """Cases of an edition that are similar enough, verified ones first."""
    near = cases.where(F.col("edition") == edition).withColumn("similarity", F.round(similarity, 6)).where(F.col("similarity") >= least)
    return near.orderBy(F.desc("verified"), F.desc("similarity"), "id").limit(k)


def first_hit(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank): least rank of a gold id per query of ``gold`` (query_id, id); null for a miss."""
    hit = ranked.join(gold, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left")


def point_get(rows: DataFrame, key: str, value, *order: str) -> DataFrame:
    return first_per(rows.where(F.col(key) == value), [key], *order)
