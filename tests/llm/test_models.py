from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import common, linear, quality, token_files, tokens, toxicity
from tests.conftest import SF001, SF01
from tests.llm.conftest import prose


def test_isotonic_pools_adjacent_violators():
    x = np.arange(6.0)
    knots, values = linear.isotonic(x, np.array([1, 1, 2, 1, 1, 1.0]), np.array([0.1, 0.5, 0.2, 0.6, 0.6, 0.9]))
    assert np.allclose(values, [0.1, 0.3, 0.6, 0.9]) and (np.diff(knots) > 0).all()


def test_sums_over_partitions(spark):
    df = spark.range(1000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features")).repartition(7)
    got = linear.summed(df, lambda b: (lambda x: (x.T @ x)[None])(linear.features_of(b)), (1, 2, 2))
    assert got[0].tolist() == [[332833500.0, 499500.0], [499500.0, 1000.0]]


def test_statistics_do_not_depend_on_neighbours(corpus):
    texts = [t or "" for _, t in corpus]
    together = quality.statistics(pa.array(texts))
    assert np.isfinite(together).all() and together.shape == (len(texts), quality.STATISTICS)
    for i in (0, 3, 61, 62, len(texts) - 1):
        assert np.allclose(quality.statistics(pa.array(["other words", texts[i]]).slice(1))[0], together[i])


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_quality_on_held_out_rows(spark):
    docs, labels = (common.table(spark, SF01, t) for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels)
    assert rows.count() == docs.count()
    got = rows.join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.97 and (held.predicted == held.quality).mean() > 0.95


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (common.table(spark, SF001, t) for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


@pytest.mark.parametrize("labels", [[], [(7, 1)], [(7, 1), (14, 1), (None, 0), (21, None)]])
def test_quality_without_two_classes(spark, clashing, corpus, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.quality_scores(clashing, table).collect()
    assert len(rows) == len(corpus) and {r.score for r in rows} == {1.0 if labels else 0.5}


def test_toxicity_chain(spark):
    rng = random.Random(5)
    bad = ["loathsome", "vile", "wretch", "brute"]
    docs, labels = [], []
    for i in range(400):
        insult, junk = i % 5 == 0, i % 7 == 0
        w = prose(rng, rng.randrange(20, 60)).split()
        for _ in range(3 * insult):
            w.insert(rng.randrange(len(w)), rng.choice(bad).title())
        docs.append((i, " ".join(w) + " click subscribe" * junk))
        if i % 3:
            labels.append((i, int(junk), int(insult), "x"))
    docs += [(1000, None), (1001, ""), (None, "null id"), (5, docs[5][1])]
    table = spark.createDataFrame(labels + [(None, 1, 1, ""), (2000, None, 1, "")], "doc_id long, junk int, insult int, words string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fold", F.lit("clash"))
    rows = toxicity.toxicity_scores(frame, table, {"junk": F.col("junk"), "insult": F.col("insult")}).collect()
    assert len(rows) == len(docs)
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    assert all((r.p_insult >= 0.5) == (r.doc_id % 5 == 0) for r in unseen)
    assert all((r.p_junk >= 0.5) == (r.doc_id % 7 == 0) for r in unseen)


def test_toxicity_without_classes(spark, make):
    none = spark.createDataFrame([], "doc_id long, y int")
    assert [r.p_y for r in toxicity.toxicity_scores(make([(1, "a"), (2, None)]), none, {"y": F.col("y")}).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    rows = toxicity.toxicity_scores(make([(1, "a"), (2, None)]), ones, {"y": F.col("y"), "z": 1 - F.col("y")}).collect()
    assert [(r.p_y, r.p_z) for r in rows] == [(1.0, 0.0)] * 2
    assert toxicity.toxicity_scores(make([]), ones, {"y": F.col("y")}).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert linear.bounded(rows, 5000).count() == 5000
    assert 800 < linear.bounded(rows, 1000).count() < 1200


def test_pipeline(spark):
    docs = common.table(spark, SF001, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    junk = {r.doc_id for r in common.table(spark, SF001, "labels").filter("quality = 0").collect()}
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, SF001), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= (before or set(texts))
            if name == "quality":
                assert len(ids & junk) <= 0.1 * len(junk)
            before = ids
            left = docs
    tok = tokens.load_tokenizer(tokens.word_tokenizer_path())
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in left.collect()}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_pipeline_of_awkward_and_of_no_documents(spark, make, corpus):
    for pairs in (corpus + corpus[:3] + [(None, None)], []):
        docs = make(pairs)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.staged(stage(spark, docs, SF001), f"test-{name}")
        assert docs.columns[0] == "doc_id"


def test_workers_need_no_path_to_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from panelcast.llm import queries
print("rows", queries.op4_token_counts(s, {SF001!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in out.stdout, out.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_file_footer_is_checked(tmp_path):
    (tmp_path / "bad.eftok").write_bytes(b"x" * 200)
    with pytest.raises(ValueError, match="no token file"):
        token_files.TokenFile(str(tmp_path), "bad.eftok")


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, make):
    text = "the river light over stone and paper in a quiet green winter garden by the window of the house "
    docs = make([(5, text), (5, text), (5, text), (9, text), (7, "an ocean of music that was never like the candle in the mirror at all"), (None, None), (None, None)])
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, text), (7, docs.filter("doc_id = 7").first().text), (None, None)], key=str)
