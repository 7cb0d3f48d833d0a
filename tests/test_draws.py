"""Draws: range, moments, independence of streams, shared streams, partition independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.draws import noise, stream, uniform
from furrow.operators.sampling import resample_sources, triangular_draws


def bounds(spark, n=4):
    return spark.range(n).select("id", F.lit(1.0).alias("lo"), F.lit(2.0).alias("mid"),
                                 F.lit(6.0).alias("hi"))


def draws(df, shared=False, n=5000):
    out = triangular_draws(df, {"x": ("lo", "mid", "hi"), "y": ("lo", "mid", "hi")}, ["id"], n,
                           ["id"], shared=shared)
    return out.toPandas().sort_values(["id", "Id_sample"])


def test_range_and_mean(spark):
    x = draws(bounds(spark))["x"]
    assert x.min() >= 1.0 and x.max() <= 6.0
    assert x.mean() == pytest.approx(3.0, abs=0.03)


def test_streams_are_independent_and_shared_streams_equal(spark):
    own = draws(bounds(spark))
    by_id = [own[own.id == i] for i in range(4)]
    for a, b in [(by_id[0].x, by_id[1].x), (by_id[0].x, by_id[0].y), (by_id[2].y, by_id[3].x)]:
        assert abs(np.corrcoef(a.to_numpy(), b.to_numpy())[0, 1]) < 0.05
    serial = by_id[0].x.to_numpy()
    assert abs(np.corrcoef(serial[:-1], serial[1:])[0, 1]) < 0.05
    common = draws(bounds(spark), shared=True)
    assert (common[common.id == 0].x.to_numpy() == common[common.id == 3].x.to_numpy()).all()


def test_uniform_fills_the_unit_interval_evenly(spark):
    u = spark.range(1, 20001).select(uniform(stream("v", F.lit(7)), noise("id")).alias("u")).toPandas().u
    counts = np.histogram(u, bins=20, range=(0, 1))[0]
    assert ((counts - 1000) ** 2 / 1000).sum() < 45
    assert u.between(0, 1, inclusive="neither").all()


def test_partitioning_does_not_change_draws(spark):
    one = draws(bounds(spark, 50).coalesce(1), n=20)
    many = draws(bounds(spark, 50).repartition(7), n=20)
    assert (one.to_numpy() == many.to_numpy()).all()


def test_point_and_invalid_bounds(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, 2.0), (2, 3.0, 2.0, 4.0), (3, None, 1.0, 2.0)],
                               "id bigint, lo double, mid double, hi double")
    got = {r.id: r.x for r in triangular_draws(df, {"x": ("lo", "mid", "hi")}, ["id"], 1).collect()}
    assert got == {1: 2.0, 2: None, 3: None}


def test_resample_gives_one_source_per_sample_and_uses_all(spark):
    pairs = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("a", "s3"), ("a", "s3"), ("b", "s1")],
                                  "id string, src string")
    out = resample_sources(pairs, ["id"], "src", 3000).toPandas()
    assert (out.groupby(["id", "Id_sample"]).size() == 1).all() and len(out) == 6000
    share = out[out.id == "a"].src.value_counts(normalize=True)
    assert share.between(0.30, 0.37).all() and len(share) == 3


def test_millions_of_rows_have_streams_of_their_own(spark):
    ids = spark.range(3_000_000).select(stream("v", "id").alias("s"))
    assert ids.agg(F.count_distinct("s")).first()[0] == 3_000_000


def test_both_halves_of_a_stream_decide_the_draws(spark):
    """Streams that agree in one half of their bits draw differently."""
    ids = spark.createDataFrame([(i, s) for i, s in enumerate([5, 5 + (1 << 32), 6, -5, (1 << 62) + 5])], "i int, s long")
    u = ids.crossJoin(spark.range(1, 2001).toDF("sample")).select(
        "i", "sample", uniform("s", noise("sample")).alias("u")).toPandas().pivot(index="sample", columns="i", values="u")
    correlation = np.corrcoef(u.to_numpy().T)
    assert (np.abs(correlation - np.eye(5)) < 0.08).all() and u.mean().between(0.47, 0.53).all()
