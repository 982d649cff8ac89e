"""Spectral transforms and variance decomposition over the embedding vectors."""

from pyspark.sql import functions as F

from ..functions import spectral as S
from ..operators import collapse, variance
from ..operators.ordered import exact_percentiles
from .registry import query, r6, rounded

BANDS = 64
LONG = "long AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS b FROM embeddings)"
SNV = f"""{LONG}, snv AS (
  SELECT vec_id, label, b, CASE WHEN stddev_pop(x) OVER w > 1e-6 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS x
  FROM long WINDOW w AS (PARTITION BY vec_id)
)"""


def exploded(df, vector, *keep):
    return df.select(*keep, F.posexplode(vector).alias("band", "x")).select(*keep, "band", r6("x").alias("x"))


@query("snv", f"WITH {SNV} SELECT vec_id, CAST(b AS INTEGER) AS band, round(x, 6) + 0.0 AS x FROM snv")
def snv(t):
    return exploded(t.embeddings.select("vec_id", S.snv("embedding").alias("v")), "v", "vec_id")


@query("band_select", f"WITH {LONG} SELECT vec_id, CAST(b - 8 AS INTEGER) AS band, round(x, 6) AS x FROM long WHERE b >= 8 AND b < 40")
def band_select(t):
    return exploded(t.embeddings.select("vec_id", S.band_select(S.doubles("embedding"), 8, 40).alias("v")), "v", "vec_id")


@query(
    "absorbance",
    f"""WITH {LONG} SELECT vec_id, CAST(b AS INTEGER) AS band, round(-log10(greatest(x, 1e-4)), 6) + 0.0 AS x FROM long""",
)
def absorbance(t):
    return exploded(t.embeddings.select("vec_id", S.absorbance_spectrum("embedding").alias("v")), "v", "vec_id")


def weight_rows(deriv: int) -> str:
    w = S.savgol_weights(deriv)
    return ", ".join(f"({r}, {j}, {float(w[r, j])!r}::DOUBLE)" for r in range(11) for j in range(11))


def savgol_sql(deriv: int) -> str:
    return f"""WITH {SNV}, w(r, j, w) AS (VALUES {weight_rows(deriv)}),
spot AS (SELECT g.b, least(greatest(g.b - 5, 0), {BANDS - 11}) AS s FROM (SELECT unnest(range({BANDS})) AS b) g)
SELECT vec_id, CAST(spot.b AS INTEGER) AS band, round(sum(w.w * snv.x), 6) + 0.0 AS x
FROM spot JOIN w ON w.r = spot.b - spot.s JOIN snv ON snv.b = spot.s + w.j GROUP BY vec_id, spot.b"""


@query("savgol_deriv1", savgol_sql(1))
def savgol_deriv1(t):
    return exploded(t.embeddings.select("vec_id", S.spectrum_pipeline("embedding", 1).alias("v")), "v", "vec_id")


@query("savgol_deriv2", savgol_sql(2))
def savgol_deriv2(t):
    return exploded(t.embeddings.select("vec_id", S.spectrum_pipeline("embedding", 2).alias("v")), "v", "vec_id")


@query(
    "center_bands",
    f"WITH {LONG} SELECT vec_id, CAST(b AS INTEGER) AS band, round(x - avg(x) OVER (PARTITION BY b), 6) + 0.0 AS x FROM long",
)
def center_bands(t):
    out = variance.center_bands(t.embeddings.select("vec_id", "embedding"), "embedding", BANDS)
    return exploded(out, "embedding", "vec_id")


@query(
    "center_within",
    f"WITH {LONG} SELECT vec_id, CAST(b AS INTEGER) AS band, round(x - avg(x) OVER (PARTITION BY label, b), 6) + 0.0 AS x FROM long",
)
def center_within(t):
    out = variance.center_within(t.embeddings, "embedding", BANDS, "label")
    return exploded(out, "embedding", "vec_id")


@query(
    "zscore_within",
    """SELECT doc_id, round(CASE WHEN count(*) OVER w >= 4 AND stddev_pop(n_chars) OVER w >= 1e-9
  THEN (n_chars - avg(n_chars) OVER w) / stddev_pop(n_chars) OVER w END, 6) + 0.0 AS z
FROM documents WINDOW w AS (PARTITION BY lang, source)""",
)
def zscore_within(t):
    out = variance.zscore_within(t.documents.select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars")
    return out.select("doc_id", r6("z").alias("z"))


@query(
    "delta_spectrum",
    f"""WITH {SNV}, pairs AS (SELECT s.label, b, avg(s.x) FILTER (e.embedding[1] >= 0) - avg(s.x) FILTER (e.embedding[1] < 0) AS x
  FROM snv s JOIN embeddings e ON s.vec_id = e.vec_id GROUP BY 1, 2)
SELECT label, CAST(b AS INTEGER) AS band, round(x, 6) + 0.0 AS x FROM pairs WHERE x IS NOT NULL""",
)
def delta_spectrum(t):
    """Late minus early slot per class; the sign of the first band plays the slot."""
    v = t.embeddings.select(
        "label", F.when(F.col("embedding")[0] < 0, "early").otherwise("late").alias("slot"), S.snv("embedding").alias("v")
    )
    blocks = v.groupBy("label", "slot").agg(collapse.mean_vector("v", BANDS).alias("v"))
    return exploded(collapse.delta_block(blocks, "label", "slot", "v", "early", "late"), "v", "label")


@query(
    "class_mean_spectrum",
    f"""WITH {LONG}, grand AS (SELECT b, avg(x) AS g FROM long GROUP BY b),
per AS (SELECT label, b, avg(x) AS m, count(*) AS n FROM long GROUP BY label, b)
SELECT label, CAST(n AS BIGINT) AS n, CAST(b AS INTEGER) AS band, round(m, 6) + 0.0 AS mean, round(m - g, 6) + 0.0 AS deviation
FROM per JOIN grand USING (b)""",
)
def class_mean_spectrum(t):
    return rounded(variance.class_mean_spectrum(t.embeddings, "embedding", BANDS, "label"), "mean", "deviation")


ETA = f"""{LONG}, grand AS (SELECT b, avg(x) AS g, var_pop(x) * count(*) AS ss FROM long GROUP BY b),
per AS (SELECT label, b, avg(x) AS m, count(*) AS n FROM long GROUP BY label, b),
eta AS (SELECT b, sum(n * (m - g) * (m - g)) / max(ss) AS e FROM per JOIN grand USING (b) GROUP BY b)"""


@query("eta_squared", f"WITH {ETA} SELECT CAST(b AS INTEGER) AS pc, round(e, 6) AS eta2 FROM eta")
def eta_squared(t):
    return rounded(variance.eta_squared(t.embeddings, "embedding", BANDS, "label"), "eta2")


@query(
    "variance_split",
    f"WITH {ETA} SELECT CAST(b AS INTEGER) AS pc, round(100 * e, 6) AS between_pct, round(100 * (1 - e), 6) AS within_pct FROM eta",
)
def variance_split(t):
    return rounded(variance.variance_split(t.embeddings, "embedding", BANDS, "label"), "between_pct", "within_pct")


@query(
    "one_hot",
    f"SELECT vec_id, {', '.join(f'CAST(label = {i} AS DOUBLE) AS c{i}' for i in range(10))} FROM embeddings",
)
def one_hot(t):
    v = t.embeddings.select("vec_id", S.one_hot("label", 10).alias("h"))
    return v.select("vec_id", *[F.col("h")[i].alias(f"c{i}") for i in range(10)])


def pca_input(t, deriv=0):
    return t.embeddings.select("vec_id", "label", S.spectrum_pipeline("embedding", deriv).alias("v"))


@query("pca_scores")
def pca_scores(t):
    """Six component scores of the SNV spectra."""
    v = pca_input(t)
    out = variance.project(v, "v", variance.fit_pca(v, "v", 6))
    return out.select("vec_id", *[r6(F.col("scores")[i]).alias(f"pc{i + 1}") for i in range(6)])


@query("pca_diagnostics")
def pca_diagnostics(t):
    """Hotelling T2 and residual Q over four components, with their 99 % cut lines."""
    v = pca_input(t)
    d = variance.diagnostics(v, "v", variance.fit_pca(v, "v", 4), 4)
    both = d.select(
        "vec_id", F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("x")) for c in ("t2", "q")]))
    )
    cuts = exact_percentiles(both, ["stat"], "x", {"cut99": 0.99}).drop("n")
    out = both.join(cuts, "stat")
    return out.select("vec_id", "stat", r6("x").alias("x"), r6("cut99").alias("cut99"), (F.col("x") > F.col("cut99")).alias("outlier"))


@query("pca_controls")
def pca_controls(t):
    """Explained variance and the class share of every component, raw and derivative."""
    parts = []
    for deriv in (0, 1):
        v = pca_input(t, deriv)
        fit = variance.fit_pca(v, "v", 6)
        eta = variance.eta_squared(variance.project(v, "v", fit), "scores", 6, "label")
        evr = F.get(S.vector_literal(fit.evr * 100), F.col("pc"))
        cum = F.get(S.vector_literal(fit.evr.cumsum() * 100), F.col("pc"))
        parts.append(
            eta.select(
                F.lit(deriv).alias("deriv"), (F.col("pc") + 1).alias("pc"), r6(evr).alias("evr_pct"),
                r6(cum).alias("cum_evr_pct"), r6("eta2").alias("eta2_label"),
            )
        )
    return parts[0].unionByName(parts[1])
