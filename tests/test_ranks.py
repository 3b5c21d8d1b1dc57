"""The bucketed rank operators against brute force, with tiny buckets."""

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import ranks


@pytest.fixture(scope="module")
def skewed():
    """One value holds a third of the rows, one group two thirds."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random(4000) < 0.33, 1.25, np.round(rng.normal(size=4000), 2))
    g = np.where(rng.random(4000) < 0.66, "a", rng.choice(list("bcd"), 4000))
    return pd.DataFrame({"id": range(4000), "g": g, "v": v})


@pytest.mark.parametrize("buckets", [1, 40, 1200, None])
def test_group_quantiles(spark, skewed, buckets):
    df = spark.createDataFrame(skewed)
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q985": 0.985, "q1": 1.0}
    got = ranks.group_quantiles(df, ["g"], "v", probs, buckets).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part.v, p), abs=1e-12)
    whole = ranks.group_quantiles(df, [], "v", {"m": 0.5}, buckets).first()
    assert whole["m"] == pytest.approx(np.median(skewed.v)) and whole["n"] == 4000


@pytest.mark.parametrize("buckets", [9, None])
def test_cdf_and_percentile_ranks(spark, skewed, buckets):
    df = spark.createDataFrame(skewed)
    cdf = ranks.value_cdf(df, ["g"], "v", buckets=buckets).toPandas()
    for _, r in cdf.sample(50, random_state=1).iterrows():
        part = skewed[skewed.g == r.g]
        assert r.below_n == (part.v < r.v).sum() and r.n == (part.v == r.v).sum() and r.total_n == len(part)
    got = ranks.percentile_ranks(df, ["id"], ["v"], buckets).toPandas().set_index("id").v_rank
    want = skewed.set_index("id").v.rank(pct=True, method="average")
    assert np.allclose(got.sort_index(), want.sort_index())


@pytest.mark.parametrize("width", [16, 65_536])
def test_row_ids(spark, skewed, width):
    df = spark.createDataFrame(skewed)
    got = ranks.row_ids(df, ["g"], "id", ["id"], "rid", width).toPandas().sort_values("rid")
    want = skewed.sort_values(["g", "id"])
    assert list(got.rid) == list(range(4000)) and list(got.id) == list(want.id)
