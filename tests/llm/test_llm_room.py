"""What operators of this folder leave on disk and keep in the driver."""

from __future__ import annotations

import glob

import numpy as np
from llm_helpers import prose
from pyspark.sql import functions as F

from gristmill.llm import common, mixing, near_copies, simhash
from gristmill.llm import quality_classifier as classifier


def tables(spark):
    common.ensure_checkpoint_dir(spark)
    return set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/table-*"))


def test_classifier_leaves_no_tables(spark):
    """The tables of a model are gone when its verdicts are there, so they don't add to the disk of a pipeline's next stage."""
    docs = spark.createDataFrame([(k, prose(k, 40), "en") for k in range(60)], "doc_id long, text string, lang string")
    before = tables(spark)
    kept = classifier.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert tables(spark) == before
    assert kept.count() == 60 and kept.where("quality_bits is null").count() == 0


def test_removed_spares_what_was_not_stored(spark, tmp_path):
    given = f"{tmp_path}/table-{'0' * 32}"
    spark.range(5).write.parquet(given)
    own, other = common.stored(spark.range(7)), common.stored(spark.range(8))
    common.removed(own.union(spark.read.parquet(given)))
    assert spark.read.parquet(given).count() == 5 and other.count() == 8
    left = tables(spark)
    assert not any(x in own.inputFiles()[0] for x in left) and any(x in other.inputFiles()[0] for x in left)


def test_packed_rows_have_each_word_once():
    """Blocks of n-grams take half of what the words' hashes would; all rows come back."""
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 40, 5000, dtype=np.uint64)[np.minimum(r.zipf(1.3, 100_000) - 1, 4999)]
    grams, n = classifier.added_up([words[:-2], words[1:-1], words[2:]], np.ones(len(words) - 2, np.int64))
    found = list(classifier.blocks(grams, [n], classifier.mixed(grams[0]) + grams[1], 3))
    rows = [tuple(row) for _, data in found for row in zip(*(x.tolist() for x in classifier.unpacked(data, 3, 1)), strict=True)]
    assert sorted(rows) == list(zip(*(x.tolist() for x in (*grams, n)), strict=True))
    assert sum(len(data) for _, data in found) < 5 * len(rows)
    none = [np.zeros(0, np.uint64)] * 3
    assert [len(x) for x in classifier.unpacked(classifier.packed(none, 2), 2, 1)] == [0, 0, 0]


def test_plans_are_kept_as_short_texts(spark):
    """What the driver keeps of the plan of each finished query is bounded, however long the plan."""
    wide = spark.range(3).select("id", *[F.col("id").alias(f"c{k}") for k in range(30)])
    for k in range(20):
        wide = wide.join(spark.range(3).select("id", F.lit(k).alias(f"d{k}")), "id")
    common.stored(wide)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    text = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    assert "InsertIntoHadoopFsRelationCommand" in text and len(text) <= common.PLAN_TEXT


def broadcast_unsized(spark, begun):
    """The queries after ``begun`` that broadcast what an explode or Python has made, with no shuffle between that gives its size."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, found = store.executionsList(), []
    for x in (runs.apply(k) for k in range(runs.size())):
        if x.executionId() > begun:
            graph = store.planGraph(x.executionId())
            nodes, edges = graph.allNodes(), graph.edges()
            name = {n.id(): n.name() for n in (nodes.apply(k) for k in range(nodes.size()))}
            below = {}
            for e in (edges.apply(k) for k in range(edges.size())):
                below.setdefault(e.toId(), []).append(e.fromId())
            todo = [k for k, n in name.items() if n == "BroadcastExchange"]
            while todo:
                k = todo.pop()
                found += [x.executionId()] * (name[k] == "Generate" or name[k].startswith(("MapIn", "FlatMap")))
                todo += [n for n in below.get(k, ()) if name[n] != "Exchange"]
    return found


def last_query(spark):
    spark.range(1).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()


def test_fingerprint_search_broadcasts_nothing_exploded(spark):
    """Each fingerprint asks for some 34 keys, which Spark takes for the size of one; tables of this size are broadcast otherwise."""
    marks = [k * 0x9E3779B97F4A7C15 % (1 << 63) for k in range(200)]
    distinct = common.checkpointed(spark.createDataFrame([(m ^ flip,) for m in marks for flip in (0, 1, 3 << 40)], "fp long"))
    begun = last_query(spark)
    assert simhash.links(distinct).count() == 400 and simhash.links(distinct, 0).count() >= 400
    assert not broadcast_unsized(spark, begun)


def test_near_dedup_broadcasts_nothing_exploded(spark):
    texts = [prose(k // 2, 60) + " end" * (k % 2) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begun = last_query(spark)
    assert near_copies.without_near_copies(docs).count() == 20
    assert not broadcast_unsized(spark, begun)


def test_mixing_broadcasts_nothing_exploded(spark):
    """The blocks of a bucket and the slots of a run are many rows made of one."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    begun = last_query(spark)
    mixed = mixing.mix(docs)
    assert sorted(r["position"] for r in mixed.collect()) == list(range(mixed.count()))
    assert not broadcast_unsized(spark, begun)
