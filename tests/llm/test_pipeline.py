"""The pipeline's stages, and the queries with SQL."""

import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontam, neardup, quality, queries, toxicity
from larkspur.llm.common import table

from test_ops import plain_targets

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    order = [got.columns.index(d[0]) for d in cursor.description]
    assert sorted(tuple(r[k] for k in order) for r in got.collect()) == sorted(cursor.fetchall())


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == (columns if k < 4 else [*columns, "copy"])
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.collect()}
        if name == "near-duplicates":
            sets = {i: neardup.shingle_set(x, 5) for i, x in before.items()}
            link = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert not any(link(a, b) for a in after for b in after if a < b)
            assert all(any(link(a, b) for b in before if b != a) for a in before.keys() - after)
        if name == "decontamination":
            found = decontam.Matcher([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
            assert after == {i for i, x in before.items() if not found.find(x)}
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] > 0
    assert docs.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).filter("m <> n OR m > 3").count() == 0


def test_run_as_plain_stages(spark):
    """run()'s rows from plain versions of all stages: models on whole lists, all pairs of sets, every item in every text, rates by rounds."""
    labels = {name: {r.doc_id: r[name] for r in table(spark, SF, "labels").collect()} for name in ("toxic", "quality")}
    items = decontam.Matcher([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}

    def model(make, docs, name, of, left_out):
        rows = sorted((i, r.text or "", labels[name][i]) for i, r in docs.items() if i in labels[name] and zlib.crc32(str(i).encode()) % of != left_out)
        return make([(x, y) for _, x, y in rows], {0: 1.0, 1: 1.0})

    for make, name, of, left_out, keeps in ((toxicity.Model, "toxic", 4, 2, lambda p: p < 0.3), (quality.Classifier, "quality", 3, 1, lambda p: p >= 0.5)):
        m = model(make, docs, name, of, left_out)
        docs = {i: r for i, r in docs.items() if keeps(m.scores([r.text or ""])[0])}
    sets, low = {i: neardup.shingle_set(r.text, 5) for i, r in docs.items()}, {i: i for i in docs}
    while any(low[a] != low[b] for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and not low.update({k: min(low[a], low[b]) for k in docs if low[k] in (low[a], low[b])})):
        pass
    docs = {i: r for i, r in docs.items() if low[i] == i and not items.find(r.text)}
    sizes = {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    targets = plain_targets(sizes)
    want = {}
    for i, r in docs.items():
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        times = math.floor(rate) + (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:12], 16) / 2**48 < rate - math.floor(rate))
        want |= {(i, k): r.text for k in range(1, times + 1)}
    assert {(r.doc_id, r.copy): r.text for r in corpus_pipeline.run(spark, SF).collect()} == want and len(want) > 20


def test_stages_take_odd_tables(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(20).union(spark.createDataFrame([(None, None, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", None, None, 0)], docs.schema)).withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).count()
        assert stage(spark, spark.createDataFrame([], odd.schema), SF).count() == 0
