import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specloom.functions import scalars as X
from specloom.functions import spectral as S
from specloom.operators import variance as V


def one(spark, values, build):
    df = spark.createDataFrame([(values,)], "a array<double>")
    return df.select(build("a").alias("r")).first()["r"]


def test_snv_literals(spark):
    assert one(spark, [1.0, 1.0, 1.0], S.snv) == [0.0, 0.0, 0.0]
    assert np.allclose(one(spark, [1.0, 2.0, 3.0], S.snv), [-1.224745, 0, 1.224745], atol=1e-6)
    got = one(spark, [1.0, 2.0, 3.0, math.nan], S.snv)
    assert np.allclose(got[:3], [-1.224745, 0, 1.224745], atol=1e-6) and math.isnan(got[3])


def test_absorbance_literals(spark):
    df = spark.createDataFrame([(0.0,), (-0.0005,), (1.0,), (math.nan,), (None,)], "x double")
    got = [r[0] for r in df.select(S.absorbance("x")).collect()]
    assert got[:3] == [4.0, 4.0, 0.0] and math.isnan(got[3]) and got[4] is None


@pytest.mark.parametrize("deriv", [0, 1, 2])
def test_savgol_reproduces_quadratics_everywhere(spark, deriv):
    t = np.arange(40.0)
    want = [0.5 * t**2 - 3 * t + 2, t - 3, np.ones(40)][deriv]
    got = one(spark, (0.5 * t**2 - 3 * t + 2).tolist(), lambda c: S.savgol(c, deriv))
    assert np.allclose(got, want, atol=1e-8)


def test_savgol_is_a_local_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    got = np.array(one(spark, x.tolist(), lambda c: S.savgol(c, 1)))
    at = np.arange(-5, 6)
    for i in (5, 20, 44):
        assert abs(got[i] - np.polyfit(at, x[i - 5 : i + 6], 2)[1]) < 1e-9
    edge = np.polyfit(at, x[:11], 2)
    assert abs(got[0] - np.polyval(np.polyder(edge), -5)) < 1e-9
    with pytest.raises(ValueError):
        S.savgol_weights(1, 10)


def test_patch_pixel_pipeline(spark):
    df = spark.createDataFrame([([1.0, 2.0, math.nan], True), ([1.0, 2.0, 3.0], False)], "a array<double>, m boolean")
    got = [r[0] for r in df.select(S.patch_pixel_pipeline("a", "m")).collect()]
    assert np.allclose(got[0], [-1, 1, 0]) and got[1] == [0.0, 0.0, 0.0]


def test_wavelengths(spark):
    w = spark.range(1).select(S.wavelengths().alias("w")).first()["w"]
    assert len(w) == 192 and np.allclose(w, np.linspace(900, 1700, 224)[8:200])


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 8)) + 5
    g = rng.integers(0, 4, 300)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "g": g, "v": list(z)}))
    return z, g, df


def test_pca_matches_numpy(cloud):
    z, _, df = cloud
    fit = V.fit_pca(df, "v", 3)
    c = z - z.mean(0)
    w, vec = np.linalg.eigh(c.T @ c / (len(z) - 1))
    w, vec = w[::-1][:3], vec[:, ::-1][:, :3]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), range(3)])
    assert np.allclose(fit.eigenvalues, w) and np.allclose(fit.loadings, vec, atol=1e-8)
    got = V.diagnostics(df, "v", fit, 3).orderBy("id").toPandas()
    s = c @ vec
    assert np.allclose(np.stack(got["scores"]), s, atol=1e-7)
    assert np.allclose(got["t2"], (s**2 / w).sum(1)) and np.allclose(got["q"], ((c - s @ vec.T) ** 2).sum(1), atol=1e-7)


def test_eta_squared_and_centering(cloud):
    z, g, df = cloud
    got = V.eta_squared(df, "v", 8, "g").orderBy("pc").toPandas()["eta2"]
    grand = z.mean(0)
    want = sum((g == k).sum() * (z[g == k].mean(0) - grand) ** 2 for k in range(4)) / ((z - grand) ** 2).sum(0)
    assert np.allclose(got, want)
    inside = V.center_within(df, "v", 8, "g")
    assert np.allclose(V.eta_squared(inside, "v", 8, "g").toPandas()["eta2"], 0, atol=1e-12)
    split = V.variance_split(df, "v", 8, "g").toPandas()
    assert np.allclose(split["between_pct"] + split["within_pct"], 100)


def test_zscore_needs_four_values(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", 1.0), ("b", 2.0)], "k string, x double")
    got = {r["k"]: r["z"] for r in V.zscore_within(df, ["k"], "x").collect() if r["k"] == "b"}
    assert got == {"b": None}


def test_scalars(spark):
    df = spark.createDataFrame([("60k",), ("2100",), ("abc",)], "s string")
    assert [r[0] for r in df.select(X.exposure_us("s")).collect()] == [60000, 2100, None]
    df = spark.createDataFrame([("A",), ("Z",), ("AA",), ("BC",)], "s string")
    assert [r[0] for r in df.select(X.column_index("s")).collect()] == [0, 25, 26, 54]
    df = spark.createDataFrame([("3",), ("2.7",), ("never",), ("-1",)], "s string")
    assert [r[0] for r in df.select(X.coerce_day("s")).collect()] == [3, 2, None, None]
    with pytest.raises(Exception, match="not an event day"):
        spark.createDataFrame([("7",)], "s string").select(X.coerce_day("s")).collect()
    key = spark.createDataFrame([("/x/preview_coco/reflectance_images/day9/dish12/dorsal/a.png",)], "p string").select(X.capture_key("p").alias("k")).first()["k"]
    assert (key["mode"], key["day"], key["dish"], key["side"]) == ("reflectance", 9, 12, "dorsal")
    row = spark.createDataFrame([("prospect1", "/a/b/real_data/c/d", "0007_00ff_w12.bin", float("inf"))], "n string, p string, f string, x double")
    got = row.select(X.short_label("n"), X.reanchor("p", "/root2"), X.line_stamp("f"), X.show_or_dash("x")).first()
    assert tuple(got) == ("pro1", "/root2/real_data/c/d", 255, "-")
    assert row.select(F.lit(1)).count() == 1
