"""The registered queries against their SQL, and the pipeline against its stages by hand."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparquill.llm import common, queries
from tests.compare import both, connect

SF = "/root/testdata/sf0.001"
SLOW_SQL = {"op9_topk_search"}


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE) - SLOW_SQL))
def test_same_rows(spark, name):
    ours, theirs = both(spark, connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ours == theirs


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(after) <= set(before)
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert len({norm(t) for t in before.values()}) == len(after) == sum(after.values())
        if name == "near_dedup":
            sets = {i: _shingles(before[i]) for i in after}
            ids = sorted(sets)
            for a in ids:
                for b in ids:
                    if a < b and sets[a] and sets[b]:
                        n = len(sets[a] & sets[b])
                        assert 100 * n < 80 * (len(sets[a]) + len(sets[b]) - n)
        before = {i: before[i] for i in after}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert sum(i in kept for i in good) >= 0.95 * len(good)  # clean documents stay


def _shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline_reruns_agree(spark):
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32")) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 2000)
    run = lambda: key(corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, docs, SF), SF))
    assert run() == run()


def test_pipeline_edge_cases(spark):
    """Null ids and texts, repeated rows, a very long text, clashing names of further columns; and no rows at all."""
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(8).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "x", 0.5) for r in good]
    rows += [rows[0], (None, rows[1][1] + " more", *rows[1][2:]), (None, None, None, None, None, None, None, None), (7, "", "en", None, 0, 1, "y", None)]
    rows += [(10**9, " ".join(f"word{i}" for i in range(60_000)), "en", "s", 1, 1, "z", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row_key long, h string, score double").repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        whole, none = stage(spark, df, SF), stage(spark, df.limit(0), SF)
        assert whole.columns == df.columns == none.columns and none.count() == 0
        made = Counter(map(tuple, whole.collect()))
        assert set(made) <= set(map(tuple, df.collect()))
        if name == "exact_dedup":
            assert sum(made.values()) == len(rows) - 2  # the repeated row, and one of the two texts without words
        if name == "near_dedup":
            assert sum(r[1] in (None, "") for r in made) == 2
        if name == "source_mixing":
            assert all(r[1] for r in made) and max(made.values()) <= 3 * 2
    first, last = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[-1][1]
    assert first(spark, df, SF).columns == df.columns and first(spark, df.limit(0), SF).count() == 0
    assert last(spark, df, SF).select("doc_id").distinct().count() == len({r[0] for r in rows}) and last(spark, df.limit(0), SF).count() == 0


def test_run_leaves_only_its_stages_behind(spark):
    made = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in made.select("doc_id").distinct().collect()}
    assert kept and kept <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    with common.scratch(spark):
        gone, stays = common.materialize(spark.range(3), "gone"), common.materialize(spark.range(3), "stays", keep=True)
        assert gone.count() == 3
    assert stays.count() == 3
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        gone.count()
