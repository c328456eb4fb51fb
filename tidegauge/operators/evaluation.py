"""Walk-forward losses, calibration and statistical tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rolling as R
from tidegauge.functions import tails
from tidegauge.functions.scalars import qlike

MODELS = ("garch", "ewma", "naive")


def aligned(frame: DataFrame, forecasts: dict[str, str] | None = None) -> DataFrame:
    """Each bar's basket_return beside the forecasts made one bar earlier; rows that lack one, or aren't positive, go."""
    names = forecasts or {"garch": "garch_vol", "ewma": "ewma_vol", "naive": "market_vol"}
    rows = frame.where("basket_return is not null")
    by = R.ordered("interval")
    out = rows.select("interval", "open_time", F.col("basket_return").alias("return"), *(F.lag(c).over(by).alias(m) for m, c in names.items()))
    return out.where(" and ".join(f"{m} > 0" for m in names))


def losses(pairs: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    rv = F.col("return") * F.col("return")
    cols: list[Column] = []
    for m in models:
        fv = F.col(m) * F.col(m)
        cols += [((rv - fv) * (rv - fv)).alias(f"{m}_squared_error"), F.abs(rv - fv).alias(f"{m}_absolute_error"), qlike(rv, fv).alias(f"{m}_qlike")]
    return pairs.select("interval", "open_time", *cols)


def plain_correlation(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL below three pairs or where a side is constant."""
    return F.when(F.count(x) >= 3, F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def metrics(pairs: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """A row per interval and model: rmse, mae, bias, qlike and correlation, and whether its QLIKE is the best."""
    long = pairs.select("interval", "open_time", "return", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).alias("model"), F.col(m).alias("vol")) for i, m in enumerate(models)))).alias("x")).select("*", "x.*")
    rv, fv = F.col("return") * F.col("return"), F.col("vol") * F.col("vol")
    out = long.groupBy("interval", "i", "model").agg(
        F.sqrt(F.avg((rv - fv) * (rv - fv))).alias("rmse"), F.avg(F.abs(rv - fv)).alias("mae"), F.avg(fv - rv).alias("bias"),
        F.avg(qlike(rv, fv)).alias("qlike"), plain_correlation(F.col("vol"), F.abs("return")).alias("corr"), F.count("*").alias("n"),
    )
    first = F.row_number().over(R.Window.partitionBy("interval").orderBy(F.asc_nulls_last("qlike"), "i")) == 1
    return out.withColumn("best", first).drop("i")


def calibration(pairs: DataFrame, forecast: str = "garch", bins: int = 10) -> DataFrame:
    """Means by quantile bucket of the forecast: right-closed between linear quantiles, equal edges dropped."""
    edges = pairs.groupBy("interval").agg(
        F.array_distinct(F.percentile(forecast, [i / bins for i in range(bins + 1)])).alias("edges"), F.count("*").alias("_n")
    ).where((F.col("_n") >= 10) & (F.size("edges") >= 2))
    v = F.col(forecast)
    bucket = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < v)))
    rows = pairs.join(F.broadcast(edges), "interval").withColumn("bucket", bucket)  # a row per interval
    return rows.groupBy("interval", "bucket").agg(
        F.avg(v).alias("forecast_vol"), F.avg(F.abs("return")).alias("realized_abs_return"), F.count("*").alias("observations"),
        F.first(F.element_at("edges", F.col("bucket"))).alias("low"), F.first(F.element_at("edges", F.col("bucket") + 1)).alias("high"),
    )


def vol_by_regime(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = pairs.join(labels.select("interval", "open_time", "regime"), ["interval", "open_time"]).where("regime is not null")
    return rows.groupBy("interval", "regime").agg(F.stddev_samp("return").alias("realized_vol"), F.avg(F.abs("return")).alias("mean_abs_return"), F.count("*").alias("observations"))


def shares(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value of a label column."""
    everything = R.Window.partitionBy("interval")
    return df.groupBy("interval", col).agg(F.count("*").alias("count")).withColumn("share", F.col("count") / F.sum("count").over(everything))


def concentration(df: DataFrame, col: str, usual: str | None = None, by: str = "interval") -> DataFrame:
    """by, n, max_share, unusual: the greatest share of one label, and how many rows have another label than the usual one; NULL labels count as usual."""
    counts = df.groupBy(by, F.col(col).alias("_l")).agg(F.count("*").alias("_n"))
    known = F.sum(F.when(F.col("_l").isNotNull(), F.col("_n")))
    most = F.max(F.when(F.col("_l").isNotNull(), F.col("_n")))
    unusual = F.coalesce(F.sum(F.when(F.col("_l") != F.lit(usual), F.col("_n"))), F.lit(0))
    return counts.groupBy(by).agg(F.coalesce(known, F.lit(0)).alias("n"), R.ratio(most, known).alias("max_share"), unusual.alias("unusual"), F.sum("_n").alias("rows"))


def forecast_losses(pairs: DataFrame, forecast: str = "garch", at_least: int = 10) -> DataFrame:
    """interval, name (MSE, MAE, QLIKE), n, statistic: mean losses of a variance forecast against squared returns; none below ten pairs."""
    rv, fv = F.col("return") * F.col("return"), F.col(forecast) * F.col(forecast)
    one = pairs.groupBy("interval").agg(F.count("*").alias("n"), F.avg((rv - fv) * (rv - fv)).alias("MSE"), F.avg(F.abs(rv - fv)).alias("MAE"), F.avg(qlike(rv, fv)).alias("QLIKE"))
    each = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("statistic")) for m in ("MSE", "MAE", "QLIKE")))
    return one.where(F.col("n") >= at_least).select("interval", "n", F.inline(each))


def qlike_ranking(rows: DataFrame, by: list[str] | None = None, tie: str = "candidate") -> DataFrame:
    """The rows with rank from 1 by avg_qlike; those without a finite one come last."""
    known = R.finite(F.col("avg_qlike"))
    w = R.Window.partitionBy(*(by or [])).orderBy(known.asc_nulls_last(), tie)
    return rows.withColumn("rank", F.row_number().over(w))


def _centred(df: DataFrame, x: str, by: str) -> DataFrame:
    every = R.Window.partitionBy(by)
    return df.where(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.avg(x).over(every)).withColumn("_n", F.count(x).over(every))


def acf(df: DataFrame, x: str, lags: int, by: str = "interval") -> DataFrame:
    """Autocorrelations with the global mean and denominator: a row per lag from 0."""
    w = R.ordered(by)
    d = _centred(df, x, by)
    for k in range(1, lags + 1):
        d = d.withColumn(f"_{k}", F.col("_d") * F.lag("_d", k).over(w))
    total = F.sum(F.col("_d") * F.col("_d"))
    one = d.groupBy(by).agg(total.alias("_t"), F.count("*").alias("n"), *(F.sum(f"_{k}").alias(f"_{k}") for k in range(1, lags + 1)))
    items = F.array(F.struct(F.lit(0).alias("lag"), F.when(F.col("_t") > 0, 1.0).alias("acf")), *(F.struct(F.lit(k).alias("lag"), R.ratio(F.col(f"_{k}"), F.col("_t")).alias("acf")) for k in range(1, lags + 1)))
    return one.select(by, "n", F.explode(items).alias("x")).select(by, "n", "x.lag", "x.acf")


def ljung_box(df: DataFrame, x: str, lags: int, by: str = "interval") -> DataFrame:
    rho = acf(df, x, lags, by).where("lag > 0")
    q = F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))) * F.first("n") * (F.first("n") + 2)
    return rho.groupBy(by).agg(q.alias("statistic"), F.first("n").alias("n"))


def jarque_bera(df: DataFrame, x: str, by: str = "interval") -> DataFrame:
    s, k = F.skewness(x), F.kurtosis(x)
    return df.groupBy(by).agg((F.count(x) / 6.0 * (s * s + k * k / 4.0)).alias("statistic"), s.alias("skewness"), (k + 3).alias("kurtosis"), F.count(x).alias("n"))


def hac_mean(df: DataFrame, x: str, by: str = "interval", lags: int = 12) -> DataFrame:
    """Mean over its Bartlett-weighted standard error, with max(1, min(lags, floor(sqrt(n)))) lags."""
    w = R.ordered(by)
    d = _centred(df, x, by)
    for k in range(1, lags + 1):
        d = d.withColumn(f"_{k}", F.col("_d") * F.lag("_d", k).over(w))
    one = d.groupBy(by).agg(F.avg(x).alias("mean"), F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_0"), *(F.sum(f"_{k}").alias(f"_{k}") for k in range(1, lags + 1)))
    most = F.greatest(F.lit(1), F.least(F.lit(lags), F.floor(F.sqrt("n")).cast("int")))
    var = F.col("_0") / F.col("n")
    for k in range(1, lags + 1):
        var = var + F.when(most >= k, 2 * (1 - k / (most + 1.0)) * F.coalesce(F.col(f"_{k}"), F.lit(0.0)) / F.col("n")).otherwise(0.0)
    one = one.withColumn("_v", var)
    stat = F.when((F.col("n") > 1) & (F.col("_v") > 0), F.col("mean") / F.sqrt(F.when(F.col("_v") > 0, F.col("_v")) / F.col("n"))).otherwise(0.0)
    return one.select(by, "n", "mean", stat.alias("statistic"))


def mincer_zarnowitz(pairs: DataFrame, forecast: str = "garch") -> DataFrame:
    """Squared return on squared forecast: the slope, and its t statistic against 1."""
    y, x = F.col("return") * F.col("return"), F.col(forecast) * F.col(forecast)
    one = pairs.groupBy("interval").agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    slope = R.ratio(F.col("sxy"), F.col("sxx"))
    se = F.sqrt(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.nullif("sxx", F.lit(0.0)))
    return one.where("n >= 20 and sxx > 0").select("interval", "n", slope.alias("slope"), F.when(se > 0, (slope - 1) / F.nullif(se, F.lit(0.0))).otherwise(0.0).alias("statistic"))


def kupiec(pairs: DataFrame, forecast: str = "garch", alpha: float = 0.05) -> DataFrame:
    """Likelihood ratio of the exceptions of a Gaussian value at risk."""
    z = tails.normal_ppf(alpha)
    one = pairs.groupBy("interval").agg(F.count("*").alias("n"), F.count_if(F.col("return") < z * F.col(forecast)).alias("x")).where("n >= 30")
    x, n = F.col("x"), F.col("n")
    p = F.least(F.greatest(x / n, F.lit(1e-12)), F.lit(1 - 1e-12))
    null = x * math.log(alpha) + (n - x) * math.log(1 - alpha)
    alt = x * F.ln(p) + (n - x) * F.ln(1 - p)
    return one.select("interval", "n", "x", F.greatest(-2 * (null - alt), F.lit(0.0)).alias("statistic"))


def max_drawdown(df: DataFrame, price: str, by: str = "interval") -> DataFrame:
    peak = F.max(price).over(R.expanding(by))
    return df.withColumn("_d", R.ratio(F.col(price), peak) - 1).groupBy(by).agg(F.min("_d").alias("max_drawdown"))


def content_hash(df: DataFrame, x: str, by: str = "interval") -> DataFrame:
    """A digest of a series in time order; its rows are hashed before they are gathered."""
    row = F.xxhash64("open_time", x)
    return df.groupBy(by).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("open_time", row.alias("h")))), lambda r: r["h"].cast("string"))), 256).alias("hash"))


def pacf(df: DataFrame, x: str, lags: int, by: str = "interval") -> DataFrame:
    """Partial autocorrelations: the last coefficient of each order's Yule-Walker equations."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        rho = f.sort_values("lag")["acf"].to_numpy()
        out = [1.0]
        for k in range(1, len(rho)):
            m = rho[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            out.append(float(np.linalg.lstsq(m, rho[1 : k + 1], rcond=None)[0][-1]))
        return pd.DataFrame({by: f[by].iloc[0], "lag": np.arange(len(rho), dtype="int32"), "pacf": out})

    return acf(df, x, lags, by).groupBy(by).applyInPandas(solve, f"{by} string, lag int, pacf double")


def arch_lm(df: DataFrame, x: str, lags: int, by: str = "interval") -> DataFrame:
    """n R-squared of squares on their own lags. The normal equations' sums come from Spark, the solve is small."""
    w = R.ordered(by)
    s = df.where(F.col(x).isNotNull()).select(by, "open_time", (F.col(x) * F.col(x)).alias("s0"))
    for k in range(1, lags + 1):
        s = s.withColumn(f"s{k}", F.lag("s0", k).over(w))
    names = ["1.0", *(f"s{k}" for k in range(1, lags + 1)), "s0"]
    cross = [F.sum(F.expr(a) * F.expr(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums = s.where(f"s{lags} is not null").groupBy(by).agg(*cross)
    size = lags + 2

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                m = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
                beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                n, total = m[0, 0], m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
                r2 = max(0.0, 1 - (m[-1, -1] - beta @ m[:-1, -1]) / total) if total > 0 else 0.0
                out.append((r[by], int(n), n * r2, tails.chi2_sf(n * r2, lags)))
            yield pd.DataFrame(out, columns=[by, "n", "statistic", "p_value"])

    return sums.mapInPandas(solve, f"{by} string, n long, statistic double, p_value double")


def with_p_value(df: DataFrame, kind: str, degrees: str = "1", approx: bool = False) -> DataFrame:
    """Adds p_value: two-sided normal or t of the statistic, or the upper chi-square tail."""

    def p(stat: float, k: float) -> float | None:
        if stat is None or math.isnan(stat):
            return None
        if kind == "chi2":
            return (tails.chi2_sf_approx if approx else tails.chi2_sf)(stat, k)
        return 2 * (tails.normal_sf(abs(stat)) if kind == "normal" else tails.t_sf(abs(stat), k))

    @F.pandas_udf("double")
    def tail(stat: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([p(a, b) for a, b in zip(stat, k)], dtype="float64")

    return df.withColumn("p_value", tail("statistic", F.expr(degrees).cast("double")))


LAGS, HAC_LAGS, VAR_LEVEL = 10, 12, 0.05


def _sums(pairs: DataFrame) -> DataFrame:
    """A row per interval with every sum that the tests of residuals, forecasts and risk need: one pass over the pairs, one aggregation."""
    w, every = R.ordered("interval"), R.Window.partitionBy("interval")
    rv = F.col("return") * F.col("return")
    fv = {m: F.col(m) * F.col(m) for m in MODELS}
    z = F.col("return") / F.col("garch")
    loss = {m: qlike(rv, v) for m, v in fv.items()}
    rows = pairs.select(*pairs.columns, z.alias("z"), (z * z).alias("s"), (loss["garch"] - loss["ewma"]).alias("e"), (loss["garch"] - loss["naive"]).alias("v"))
    rows = rows.select("*", *((F.col(x) - F.avg(x).over(every)).alias(f"d{x}") for x in "zsev"))
    lags = {"dz": LAGS, "ds": LAGS, "de": HAC_LAGS, "dv": HAC_LAGS, "s": LAGS}
    rows = rows.select("*", F.col("s").alias("s_0"), *(F.lag(x, k).over(w).alias(f"{x}_{k}") for x, most in lags.items() for k in range(1, most + 1)))
    out = [F.count("*").alias("n"), F.avg("e").alias("e"), F.avg("v").alias("v"), F.count_if(F.col("return") < tails.normal_ppf(VAR_LEVEL) * F.col("garch")).alias("below")]
    for x in ("dz", "ds", "de", "dv"):
        out += [F.sum(F.col(x) * F.col(x)).alias(f"{x}_0"), *(F.sum(F.col(x) * F.col(f"{x}_{k}")).alias(f"{x}_{k}") for k in range(1, lags[x] + 1))]
    terms = [F.lit(1.0), *(F.col(f"s_{k}") for k in range(1, LAGS + 1)), F.col("s_0")]
    full = F.col(f"s_{LAGS}").isNotNull()
    out += [F.sum(F.when(full, a * b)).alias(f"a_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    g = fv["garch"]
    out += [F.regr_sxx(rv, g).alias("sxx"), F.regr_syy(rv, g).alias("syy"), F.regr_sxy(rv, g).alias("sxy")]
    out += [F.avg((rv - g) * (rv - g)).alias("mse"), F.avg(F.abs(rv - g)).alias("mae"), F.avg(loss["garch"]).alias("qlike")]
    return rows.groupBy("interval").agg(*out)


def _tests(r: dict) -> list[tuple]:
    """group, name, statistic, p_value, n, least n, whether a small p is bad, of one interval's sums."""
    n = int(r["n"])
    known = lambda x: 0.0 if x is None or math.isnan(x) else float(x)

    def portmanteau(x: str) -> tuple:
        total = known(r[f"{x}_0"])
        if total <= 0 or n <= LAGS:
            return None, None
        q = n * (n + 2) * sum((known(r[f"{x}_{k}"]) / total) ** 2 / (n - k) for k in range(1, LAGS + 1))
        return q, tails.chi2_sf(q, LAGS)

    def arch() -> tuple:
        size = LAGS + 2
        m = np.array([[known(r[f"a_{min(i, j)}_{max(i, j)}"]) for j in range(size)] for i in range(size)])
        if m[0, 0] == 0:
            return None, None, 0
        total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
        beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        q = m[0, 0] * (max(0.0, 1 - (m[-1, -1] - beta @ m[:-1, -1]) / total) if total > 0 else 0.0)
        return q, tails.chi2_sf(q, LAGS), int(m[0, 0])

    def hac(mean: str, x: str) -> tuple:
        most = max(1, min(HAC_LAGS, math.isqrt(n)))
        var = (known(r[f"{x}_0"]) + sum(2 * (1 - k / (most + 1)) * known(r[f"{x}_{k}"]) for k in range(1, most + 1))) / n
        t = known(r[mean]) / math.sqrt(var / n) if n > 1 and var > 0 else 0.0
        return t, 2 * tails.normal_sf(abs(t))

    def slope() -> tuple:
        if n < 3 or known(r["sxx"]) <= 0:
            return None, None
        b = known(r["sxy"]) / r["sxx"]
        se = math.sqrt(max(known(r["syy"]) - b * known(r["sxy"]), 0.0) / (n - 2) / r["sxx"])
        t = (b - 1) / se if se > 0 else 0.0
        return t, 2 * tails.t_sf(abs(t), n - 2)

    def coverage() -> tuple:
        x = int(r["below"])
        p = min(max(x / n, 1e-12), 1 - 1e-12)
        lr = max(-2 * (x * math.log(VAR_LEVEL / p) + (n - x) * math.log((1 - VAR_LEVEL) / (1 - p))), 0.0)
        return lr, tails.chi2_sf(lr, 1)

    lm = arch()
    return [
        ("residual", "Ljung-Box residuals", *portmanteau("dz"), n, 20, True), ("residual", "Ljung-Box squared residuals", *portmanteau("ds"), n, 20, True),
        ("residual", "ARCH-LM", *lm[:2], lm[2], 25, True), *(("forecast", m.upper(), r[m], None, n, 10, True) for m in ("mse", "mae", "qlike")),
        ("forecast", "Diebold-Mariano vs EWMA", *hac("e", "de"), n, 20, False), ("forecast", "Mincer-Zarnowitz", *slope(), n, 20, True),
        ("risk", "Kupiec VaR coverage", *coverage(), n, 30, True), ("validation", "GARCH vs naive QLIKE", *hac("v", "dv"), n, 20, False),
    ]


def diagnostics(frame: DataFrame, params: dict[str, float] | None = None, alpha: float = 0.05, labelled: DataFrame | None = None) -> DataFrame:
    """All tests on one frame (basket_return, garch_vol, ewma_vol, market_vol): group, name, statistic, p_value, decision, n.

    labelled (interval, regime, shock_type) adds how concentrated regimes are and how many shocks there were.
    """

    def judge(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                for group, name, stat, p, n, least, bad in _tests(r):
                    if n < least:
                        stat, p, text = None, None, "insufficient sample"
                    elif p is None:
                        text = "diagnostic only"
                    elif p < alpha:
                        text = "fail diagnostic" if bad else "reject null"
                    else:
                        text = "pass diagnostic" if bad else "do not reject null"
                    out.append((r["interval"], group, name, stat, p, text, n))
            yield pd.DataFrame(out, columns=["interval", "test_group", "name", "statistic", "p_value", "decision", "n"])

    schema = "interval string, test_group string, name string, statistic double, p_value double, decision string, n long"
    out = _sums(aligned(frame)).mapInPandas(judge, schema)
    if labelled is not None:
        pair = lambda name, stat, n: F.struct(F.lit(name).alias("name"), stat.cast("double").alias("statistic"), n.cast("long").alias("n"))
        counts = labelled.groupBy("interval", "regime", "shock_type").agg(F.count("*").alias("k"))
        of_regime = F.sum(F.when(F.col("regime").isNotNull(), F.col("k")))
        each = counts.withColumn("_r", F.when(F.col("regime").isNotNull(), F.sum("k").over(R.Window.partitionBy("interval", "regime"))))
        got = each.groupBy("interval").agg(F.max("_r").alias("most"), F.coalesce(of_regime, F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col("shock_type") != "NORMAL", F.col("k"))), F.lit(0)).alias("shocks"), F.sum("k").alias("rows"))
        rows = got.select("interval", F.inline(F.array(pair("Regime concentration", R.ratio(F.col("most"), F.col("m")), F.col("m")), pair("Shock count", F.col("shocks"), F.col("rows")))))
        text = F.when(F.col("statistic").isNull(), "insufficient sample").otherwise("diagnostic only")
        out = out.unionByName(rows.select("interval", F.lit("regime").alias("test_group"), "name", "statistic", F.lit(None).cast("double").alias("p_value"), text.alias("decision"), "n"))
    if params is not None:
        found = lambda part: next((v for k, v in params.items() if part in k.lower()), None)
        a, b, nu = found("alpha"), found("beta"), found("nu")
        total = None if a is None or b is None else a + b
        rows = [("parameter", "alpha + beta < 1", total, None if total is None else total < 1), ("parameter", "nu > 2", nu, None if nu is None else nu > 2)]
        text = lambda ok: "diagnostic unavailable" if ok is None else "pass diagnostic" if ok else "fail diagnostic"
        data = [(None, g, n, v, None, text(ok), int(v is not None)) for g, n, v, ok in rows]
        out = out.unionByName(frame.sparkSession.createDataFrame(data, out.schema))
    return out
