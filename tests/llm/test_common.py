"""Scratch folders, words and ASCII case."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillframe.llm import common


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: folder))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_its_shared_folder():
    with pytest.raises(ValueError):
        common.scratch_root(session("spark://host:7077"))
    with pytest.raises(ValueError):
        common.scratch_root(session("local-cluster[2,1,1024]"))
    assert common.scratch_root(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"


def test_only_ascii_is_lowered(spark):
    texts = ["ABC é", "É A", "plain", "ÀB c", "", "İI"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.ascii_lower(F.col("t"))).collect()]
    assert got == ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]


def test_words(spark):
    texts = [None, "", " \t\n", " a\x0bb c \r\n d", "x" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.words_of(F.col("t"))).collect()]
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in texts]


def test_split_lookup_with_a_hot_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id") % 97).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("group_rows"), F.min("id").alias("first"))
    got = common.split_lookup(rows, table, "k", 6000)
    assert got.count() == 6000 and got.filter("k = 0").agg(F.max("first")).first()[0] == 0


def test_votes_match_bit_counts(spark):
    values = [0, -1, 5, 1 << 40, -(1 << 63), 77777777777]
    df = spark.createDataFrame([(1, v) for v in values], "k int, h bigint")
    fp = df.groupBy("k").agg(F.count("*").alias("n"), *common.votes(F.col("h"))).select(common.fingerprint_of(F.col("n"))).first()[0]
    want = sum(1 << b for b in range(64) if 2 * sum((v & (1 << 64) - 1) >> b & 1 for v in values) > len(values))
    assert fp & (1 << 64) - 1 == want
