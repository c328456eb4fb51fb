"""The model lab: eighteen candidates refitted at rolling origins, ranked by forecast losses.

A series is cut into blocks of origins, each with the bars its training windows and horizons reach; a grouped
function fits all candidates of a block at once, vectorised over its origins. Everything after the fits (losses, ranks,
stability, leaderboard) is DataFrame aggregation over the fits, which are computed once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import EPS, information_criteria, qlike
from tidegauge.operators.evaluation import plain_correlation
from tidegauge.operators.features import ewma

PERIOD = 24
FAMILIES = ("mean", "trend", "volatility", "combined")
# The candidates by family, in order.
MODELS = {
    "mean": ("naive_mean", "constant_mean", "ar_1", "ar_2", "ma_1", "arma_1_1", "arima_1_1_0"),
    "trend": ("rolling_ols_trend", "seasonal_ar_1", "stl_trend"),
    "volatility": ("realized_vol", "ewma_vol", "arch_1", "garch_1_1", "student_t_garch"),
    "combined": ("ar_1_garch", "arma_1_1_garch", "arima_1_1_0_garch"),
}
# Parameters counted for the volatility recursions, and which models forecast by which recursion.
PARAMETERS = {"realized_vol": 1, "ewma_vol": 2, "arch_1": 3, "garch_1_1": 4, "student_t_garch": 5, "ar_1_garch": 5, "arma_1_1_garch": 6, "arima_1_1_0_garch": 6}
BY_EWMA = ("ewma_vol", "student_t_garch")
BY_GARCH = ("arch_1", "garch_1_1", "ar_1_garch", "arma_1_1_garch", "arima_1_1_0_garch")
# The recursion's share of the unconditional variance, its weights, the moving average's weight, degrees of freedom.
OMEGA, ALPHA, BETA, THETA, NU = 0.05, 0.08, 0.90, 0.35, 8.0


@dataclass(frozen=True)
class Spec:
    model_id: str
    family: str
    target: str

    @property
    def candidate(self) -> str:
        return f"{self.model_id}:{self.target}"


def targets(view: str) -> list[str]:
    names = {"both": ["log_return", "log_price"], "log_return": ["log_return"], "log_price": ["log_price"]}
    if view not in names:
        raise ValueError(f"unknown target: {view!r}")
    return names[view]


def specs(groups: list[str] | None = None, target: str = "both", limit: int = 16) -> list[Spec]:
    """Candidates taken in turn from each family, each for all targets, cut at the limit."""
    lists = [[(m, f) for m in MODELS[f]] for f in FAMILIES if groups is None or f in groups]
    turns = [x[i] for i in range(max(map(len, lists), default=0)) for x in lists if i < len(x)]
    return list(dict.fromkeys(Spec(m, f, t) for m, f in turns for t in targets(target)))[: max(1, limit)]


def specs_frame(spark: SparkSession, chosen: list[Spec]) -> DataFrame:
    rows = [(i, s.model_id, s.family, s.target, s.candidate) for i, s in enumerate(chosen)]
    return spark.createDataFrame(rows, "ordinal int, model_id string, family string, target string, candidate string")


def lab_origins(n: int, training: int, horizon: int = 1, stride: int = 1) -> list[int]:
    """Last training index of each refit."""
    horizon, stride = max(1, horizon), max(1, stride)
    if n <= horizon + 2:
        return []
    training = max(4, min(training, max(4, n - horizon - 1)))
    return list(range(min(training - 1, n - horizon - 1), n - horizon, stride))


def simulation_origins(n: int, training: int, horizon: int = 1, stride: int = 1) -> list[int]:
    training, horizon, stride = max(1, training), max(1, horizon), max(1, stride)
    return [] if n <= training + horizon else list(range(training - 1, n - horizon, stride))


def budget(origins: list[int], most: int) -> list[int]:
    """At most so many origins, evenly spread."""
    if len(origins) <= most:
        return origins
    return [origins[i] for i in sorted(set(np.linspace(0, len(origins) - 1, most, dtype=int).tolist()))]


# ---- fits: all arrays hold one training window per row ----


def ar(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(forecast, residuals, parameters) of a least-squares autoregression; the mean where windows are too short."""
    m, n = y.shape
    if n <= p + 2:
        mean = y.mean(axis=1)
        return mean, y - mean[:, None], 2
    x = np.stack([np.ones((m, n - p)), *(y[:, p - k : n - k] for k in range(1, p + 1))], axis=2)
    beta = (np.linalg.pinv(x) @ y[:, p:, None])[:, :, 0]
    latest = np.column_stack([np.ones(m), *(y[:, -k] for k in range(1, p + 1))])
    return (latest * beta).sum(axis=1), y[:, p:] - (x @ beta[:, :, None])[:, :, 0], p + 2


def ma(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = y.mean(axis=1)
    e = np.empty_like(y)
    before = np.zeros(len(y))
    for t in range(y.shape[1]):
        before = e[:, t] = y[:, t] - mean - THETA * before
    return mean + THETA * before, e


def line(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centred time, slopes) of least-squares lines."""
    t = np.arange(y.shape[1]) - (y.shape[1] - 1) / 2
    return t, y @ t / (t @ t)


def mean_model(model: str, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(forecast, residuals, parameters) of a candidate's mean."""
    n = y.shape[1]
    mean = y.mean(axis=1)
    if model == "constant_mean":
        return mean, y - mean[:, None], 2
    if model in ("ar_1", "ar_2"):
        return ar(y, int(model[-1]))
    if model == "ma_1":
        return *ma(y), 3
    if model == "arma_1_1":
        f, e, _ = ar(y, 1)
        g, r = ma(e)
        return f + g, r, 4
    if model.startswith("arima"):
        f, e, _ = ar(np.diff(y, axis=1), 1)
        return y[:, -1] + f, e, 4
    if model == "rolling_ols_trend":
        t, slope = line(y)
        return mean + slope * (n - (n - 1) / 2), y - mean[:, None] - slope[:, None] * t, 3
    if model == "seasonal_ar_1":
        if n <= PERIOD + 4:
            return ar(y, 1)
        f, e, _ = ar(y[:, PERIOD:] - y[:, :-PERIOD], 1)
        return y[:, -PERIOD] + f, e, 4
    if model == "stl_trend":
        if n <= PERIOD:
            return mean, y - mean[:, None], 2
        return y[:, -PERIOD].copy(), y - y[:, -PERIOD:].mean(axis=1)[:, None], 4
    return np.zeros(len(y)), y, 1


def shifted(model: str, n: int) -> bool:
    """Whether residuals are the values less a constant. They have the values' variance, and by taking it from these models tie to the last bit."""
    return model in ("constant_mean", "stl_trend") or (model == "ar_2" and n <= 4)


def trend_variance(y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Variance about a line: the values' variance less what the slope explains, so that a slope of zero but for rounding ties with the mean
    to the last bit. Where the slope explains most, the difference would lose digits and the residuals' variance is taken."""
    t, slope = line(y)
    whole, explained = y.var(axis=1, ddof=1), slope * slope * (t @ t) / (y.shape[1] - 1)
    return np.where(explained < whole / 2, whole - explained, e.var(axis=1, ddof=1))


def variance(model: str, e: np.ndarray) -> np.ndarray:
    n = e.shape[1]
    if n < 2:
        return np.full(len(e), EPS)
    span = min(30, max(4, n // 3))
    whole = e.var(axis=1, ddof=1)
    if model in BY_EWMA:
        v, a = e[:, 0] ** 2, 2 / (span + 1)
        for t in range(1, n):
            v = a * e[:, t] ** 2 + (1 - a) * v
        return np.maximum(v if n >= 3 else whole, EPS)
    if model in BY_GARCH:
        base = np.maximum(whole, EPS)
        v = base.copy()
        for t in range(n):
            v = OMEGA * base + ALPHA * e[:, t] ** 2 + BETA * v
        return np.maximum(v, EPS)
    return e[:, -span:].var(axis=1, ddof=1) if model == "realized_vol" else whole


def log_likelihood(model: str, e: np.ndarray, v: np.ndarray) -> np.ndarray:
    v = np.maximum(v, EPS)
    if model not in BY_GARCH and model != "student_t_garch":
        return -0.5 * (np.log(2 * math.pi * v)[:, None] + e * e / v[:, None]).sum(axis=1)
    beta = 0.0 if model == "arch_1" else BETA
    s, out = np.maximum(e.var(axis=1), EPS), np.zeros(len(e))
    const = math.lgamma((NU + 1) / 2) - math.lgamma(NU / 2)
    for t in range(e.shape[1]):
        q = e[:, t] ** 2
        s = np.maximum(OMEGA * v + ALPHA * q + beta * s, EPS)  # the recursion sees the same bar's square
        if model == "student_t_garch":
            out += const - 0.5 * np.log((NU - 2) * math.pi * s) - (NU + 1) / 2 * np.log1p(q / s / (NU - 2))
        else:
            out += -0.5 * (np.log(2 * math.pi * s) + q / s)
    return out


def fit(model: str, y: np.ndarray) -> dict[str, np.ndarray | int]:
    """A candidate's forecasts for each window; windows of fewer than four values don't converge."""
    m = len(y)
    if y.shape[1] < 4:
        none = np.full(m, np.nan)
        return {"ok": np.zeros(m, bool), "k": 0, "n": 1, "ll": none, "mean": np.zeros(m), "variance": np.full(m, EPS)}
    forecast, e, k = mean_model(model, y)
    v = trend_variance(y, e) if model == "rolling_ols_trend" else variance(model, y if shifted(model, y.shape[1]) else e)
    return {"ok": np.ones(m, bool), "k": max(k, PARAMETERS.get(model, k)), "n": max(1, e.shape[1]), "ll": log_likelihood(model, e, v), "mean": forecast, "variance": v}


def indexed(series: DataFrame, by: list[str], value: str = "y") -> DataFrame:
    """by, open_time, y and i (from 0): the series' finite values in time order, and their number n."""
    w = Window.partitionBy(*by).orderBy("open_time")
    clean = series.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return clean.select(*by, "open_time", F.col(value).alias("y")).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def fits(points: DataFrame, chosen: list[Spec], by: list[str], origins: DataFrame, training: int, horizon: int, block: int = 256) -> DataFrame:
    """One row per origin and candidate of the origin's target.

    points: by, target, open_time, y, i. origins: by, target, origin, the last training index, and perhaps candidates, the names to which
    the series is restricted. A block holds `block` bars of
    origins and the bars that they reach.
    """
    reach = F.explode(F.sequence(F.floor((F.col("i") - horizon) / block).cast("long"), F.floor((F.col("i") + training - 1) / block).cast("long")))
    rows = points.select(*by, "target", "open_time", "y", "i").withColumn("block", reach).where("block >= 0")
    only = F.col("candidates") if "candidates" in origins.columns else F.array(*(F.lit(s.candidate) for s in chosen))
    wanted = origins.select(*by, "target", F.col("origin").alias("i"), F.lit(True).alias("is_origin"), only.alias("only"))
    rows = rows.join(wanted, [*by, "target", "i"], "left")
    models = [(s.model_id, s.family, s.target) for s in chosen]
    key_types = {f.name: f.dataType for f in points.schema.fields}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        first = int(f["block"].iloc[0]) * block
        i, y, at = f["i"].to_numpy(), f["y"].to_numpy(float), f["open_time"].to_numpy()
        mine = np.flatnonzero(f["is_origin"].notna().to_numpy() & (i >= first) & (i < first + block))
        mine = mine[mine + horizon < len(i)]
        allowed = set(f["only"].iloc[mine[0]]) if len(mine) else set()
        out = []
        for length in np.unique(np.minimum(training, i[mine] + 1)):
            part = mine[np.minimum(training, i[mine] + 1) == length]
            windows = np.lib.stride_tricks.sliding_window_view(y, length)[part - length + 1]
            for model, family, target in models:
                if target != f["target"].iloc[0] or f"{model}:{target}" not in allowed:
                    continue
                g = fit(model, windows)
                frame = pd.DataFrame({"origin": i[part], "origin_time": at[part], "realization_time": at[part + horizon], "train_start_time": at[part - length + 1]})
                frame["nobs"], frame["at_origin"], frame["realized"] = int(length), y[part], y[part + horizon]
                frame["model_id"], frame["family"], frame["converged"] = model, family, g["ok"]
                frame["parameter_count"], frame["residuals"] = int(g["k"]), int(g["n"])
                frame["log_likelihood"], frame["forecast_mean"], frame["forecast_variance"] = g["ll"], g["mean"], np.maximum(g["variance"], EPS)
                out.append(frame)
        names = [*by, "target"]
        got = pd.concat(out) if out else pd.DataFrame(columns=FIT_COLUMNS)
        return got.assign(**{k: f[k].iloc[0] for k in names})[[*names, *FIT_COLUMNS]]

    keys = ", ".join(f"`{k}` {key_types[k].simpleString()}" for k in [*by, "target"])
    raw = rows.groupBy(*by, "target", "block").applyInPandas(run, f"{keys}, {FIT_SCHEMA}")
    k, n = F.col("parameter_count"), F.col("residuals")
    ll = F.when(~F.isnan("log_likelihood"), F.col("log_likelihood"))
    aic, bic, hqic = information_criteria(ll, k, n)
    return raw.withColumn("log_likelihood", ll).withColumns({"aic": aic, "bic": bic, "hqic": hqic}).withColumn("candidate", F.concat_ws(":", "model_id", "target"))


FIT_SCHEMA = (
    "origin int, origin_time timestamp_ntz, realization_time timestamp_ntz, train_start_time timestamp_ntz, nobs int, at_origin double, realized double, "
    "model_id string, family string, converged boolean, parameter_count int, residuals int, log_likelihood double, forecast_mean double, forecast_variance double"
)
FIT_COLUMNS = [part.split()[0] for part in FIT_SCHEMA.split(", ")]


def origin_frame(points: DataFrame, by: list[str], training: int, horizon: int, stride: int, most: int | None = None, simulation: bool = False) -> DataFrame:
    """by, target, origin for each series, from its length; with `most`, evenly thinned."""
    h, s = max(1, horizon), max(1, stride)
    n = F.col("n").cast("int")
    sizes = points.select(*by, "target", "n").distinct()
    if simulation:
        first, enough = F.lit(max(1, training) - 1), n > max(1, training) + h
    else:
        length = F.greatest(F.lit(4), F.least(F.lit(training), F.greatest(F.lit(4), n - h - 1)))
        first, enough = F.least(length - 1, n - h - 1), n > h + 2
    last = n - h - 1
    rows = sizes.where(enough & (first <= last)).withColumn("origins", F.sequence(first, last, F.lit(s)))
    if most is not None:
        size = F.size("origins")
        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (size - 1) / F.lit(float(max(1, most - 1)))).cast("int")))
        thin = F.transform(places, lambda j: F.get("origins", j))
        rows = rows.withColumn("origins", F.when(size > most, thin).otherwise(F.col("origins")))
    return rows.select(*by, "target", F.explode("origins").alias("origin"))


def with_losses(fitted: DataFrame, squared_change: bool = False) -> DataFrame:
    """Adds realised variance and losses. In a simulation the target log_price counts by its change, and losses are absolute."""
    change = F.when(F.col("target") == "log_price", F.col("realized") - F.col("at_origin")).otherwise(F.col("realized")) if squared_change else F.col("realized")
    rv = F.greatest(F.col("_c") * F.col("_c"), F.lit(EPS)) if squared_change else F.col("_c") * F.col("_c")
    d = F.col("realized_variance") - F.col("forecast_variance")
    return (
        fitted.withColumn("_c", change).withColumn("realized_return", F.col("_c")).withColumn("realized_variance", rv)
        .withColumn("qlike", qlike(F.col("realized_variance"), F.col("forecast_variance")))
        .withColumn("rmse_loss", F.abs(d) if squared_change else d * d).withColumn("mae_loss", F.abs(d))
        .withColumn("forecast_volatility", F.sqrt("forecast_variance")).withColumn("realized_volatility", F.sqrt("realized_variance")).drop("_c")
    )


def evaluate(fitted: DataFrame, by: list[str]) -> DataFrame:
    """Per candidate the criteria of its last fit and the means of its losses."""
    last = lambda c: F.max_by(c, "origin").alias(c)
    fv, rv = F.col("forecast_variance"), F.col("realized_variance")
    return fitted.groupBy(*by, "target", "candidate", "model_id", "family").agg(
        *(last(c) for c in ("log_likelihood", "aic", "bic", "hqic", "parameter_count", "converged")),
        F.sqrt(F.avg((rv - fv) * (rv - fv))).alias("avg_rmse"), F.avg(F.abs(rv - fv)).alias("avg_mae"), F.avg("qlike").alias("avg_qlike"),
        F.avg(fv - rv).alias("forecast_bias"), plain_correlation(F.sqrt(fv), F.abs("realized")).alias("forecast_realized_corr"),
        F.avg((F.signum("forecast_mean") == F.signum("realized")).cast("double")).alias("directional_agreement_rate"),
        F.count("*").alias("evaluation_origins"),
    )


def timeline(fitted: DataFrame, by: list[str]) -> DataFrame:
    """The fits with their dense rank by QLIKE at each origin."""
    w = Window.partitionBy(*by, "target", "origin").orderBy("qlike")
    return fitted.withColumn("rank", F.dense_rank().over(w))


def rank_heatmap(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by, "candidate", "realization_time").agg(F.min("rank").alias("rank"))


def rank_stability(lines: DataFrame, by: list[str]) -> DataFrame:
    """1 / (1 + mean absolute rank change) in time order; 1 for a single rank."""
    w = Window.partitionBy(*by, "candidate").orderBy("realization_time")
    step = F.abs(F.col("rank") - F.lag("rank").over(w))
    return lines.withColumn("_d", step).groupBy(*by, "candidate").agg((1 / (1 + F.coalesce(F.avg("_d"), F.lit(0.0)))).alias("rank_stability"))


def dense_rank_or_last(metric: str, by: list[str], ascending: bool = True) -> Column:
    """Dense rank among the rows that have the metric; for the others the number of rows."""
    order = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(order))
    return F.when(F.col(metric).isNotNull(), rank).otherwise(F.count("*").over(Window.partitionBy(*by)))


def levelled(rows: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Equal values added up in different orders differ in their last bits: means within 1e-12 of the next smaller one become the least of them."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(metric))
    apart = F.col(metric) - F.lag(metric).over(w) > 1e-12 * F.abs(metric)
    out = rows.withColumn("_level", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("_level", F.sum("_level").over(w))
    return out.withColumn(metric, F.min(metric).over(Window.partitionBy(*by, "_level"))).drop("_level")


def leaderboard(stage: DataFrame, stability: DataFrame | None, by: list[str], ordinals: DataFrame) -> DataFrame:
    """Composite score and rank of each candidate; ties keep the candidates' order."""
    out = stage.join(stability, [*by, "candidate"], "left") if stability is not None else stage.withColumn("rank_stability", F.lit(None).cast("double"))
    out = out.join(F.broadcast(ordinals.select("candidate", "ordinal")), "candidate").withColumn("rank_stability", F.coalesce("rank_stability", F.lit(0.0)))
    for metric in ("avg_qlike", "avg_rmse", "avg_mae"):
        out = levelled(out, metric, by)
    score = F.when(F.col("converged"), 0).otherwise(F.count("*").over(Window.partitionBy(*by)))
    for metric, weight in (("aic", 1), ("bic", 1), ("hqic", 1), ("avg_qlike", 2), ("avg_rmse", 1), ("avg_mae", 1)):
        score = score + weight * dense_rank_or_last(metric, by)
    out = out.withColumn("composite_rank_score", (score + dense_rank_or_last("rank_stability", by, False)).cast("double"))
    w = Window.partitionBy(*by).orderBy("composite_rank_score", F.asc_nulls_last("avg_qlike"), F.asc_nulls_last("aic"), "ordinal")
    return out.withColumn("rank", F.row_number().over(w))


def top_candidates(board: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("composite_rank_score", F.asc_nulls_last("avg_qlike"), "ordinal")
    return board.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


@dataclass(frozen=True)
class LabResult:
    stage1: DataFrame
    stage2: DataFrame
    timeline: DataFrame
    heatmap: DataFrame
    leaderboard: DataFrame


def run_lab(series: DataFrame, by: list[str], chosen: list[Spec], training: int, horizon: int = 1, stride: int = 1, mode: str = "two_stage") -> LabResult:
    """Stage 1 fits all candidates at few origins; stage 2 the best of them (all in detailed mode, five in fast) at all origins.

    series: by, target, open_time, y. Each series and target keeps its own best candidates of stage 1.
    """
    spark = series.sparkSession
    points = indexed(series, [*by, "target"])
    ordinals = specs_frame(spark, chosen)
    most = max(1, points.groupBy(*by, "target").agg(F.max("n").alias("n")).agg(F.max("n")).first()[0] or 1)
    count = len(lab_origins(most, training, horizon, stride))
    few = origin_frame(points, by, training, horizon, stride, max(8, min(40, count // 2)))
    stage1 = leaderboard(evaluate(with_losses(fits(points, chosen, by, few, training, horizon)), by), None, [*by, "target"], ordinals)
    every = origin_frame(points, by, training, horizon, stride)
    if mode != "detailed":
        k = 5 if mode == "fast" else max(3, min(6, len(chosen) // 2))
        best = top_candidates(stage1, k, [*by, "target"]).groupBy(*by, "target").agg(F.collect_list("candidate").alias("candidates"))
        every = every.join(best, [*by, "target"])
    fitted = with_losses(fits(points, chosen, by, every, training, horizon))
    lines = timeline(fitted, by)
    stage2 = evaluate(fitted, by)
    board = leaderboard(stage2, rank_stability(lines, by), by, ordinals)
    return LabResult(stage1, stage2, lines, rank_heatmap(lines, by), board)


def model_uncertainty(board: DataFrame, by: list[str]) -> DataFrame:
    """From the gap between the two best scores: at most 1 high, at most 3 moderate, else low."""
    w = Window.partitionBy(*by).orderBy("rank")
    gap = board.withColumn("gap", F.lead("composite_rank_score").over(w) - F.col("composite_rank_score")).where("rank = 1")
    return gap.select(*by, "candidate", "gap", F.when(F.col("gap") <= 1, "high").when(F.col("gap") <= 3, "moderate").otherwise("low").alias("uncertainty"))


def select_model(board: DataFrame, by: list[str], metric: str = "aic") -> DataFrame:
    """The candidate with the least metric."""
    return board.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by("candidate", metric).alias("candidate"), F.min(metric).alias(metric))


def fit_counts(n: int, chosen: int, training: int, horizon: int, stride: int, seconds_low: float = 0.005, seconds_high: float = 0.040) -> dict[str, float]:
    """How many fits a two-stage run takes, and the time that heuristic figures per fit give."""
    all_origins = len(lab_origins(n, training, horizon, stride))
    first = min(all_origins, max(8, min(40, all_origins // 2))) * chosen
    second = all_origins * max(3, min(6, chosen // 2))
    return {"stage1": first, "stage2": second, "total": first + second, "seconds_low": (first + second) * seconds_low, "seconds_high": (first + second) * seconds_high}


#: Values that a GARCH fit sees at most and at least, and refits of one history.
FIT_MOST, FIT_LEAST, REFITS = 5000, 100, 12


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _decayed(u: np.ndarray, b: float) -> np.ndarray:
    """x[t] = b * x[t - 1] + u[t], by doubling; stops where what is left of a value is nothing."""
    x, k, factor = u.copy(), 1, b
    while k < len(x) and factor > 1e-18:
        x[k:] = x[k:] + factor * x[:-k]
        k, factor = 2 * k, factor * factor
    return x


def garch_likelihood(z: np.ndarray, q: np.ndarray, base: float) -> tuple[float, np.ndarray, float]:
    """Minus the log-likelihood of squares q with its gradient, and the next variance.

    z: logarithm of omega over base, logits of the persistence and of alpha's share in it, logarithm of nu - 2.05. The first variance is base.
    """
    persistence, share = 1 / (1 + math.exp(-z[1])), 1 / (1 + math.exp(-z[2]))
    omega, a, b, extra = math.exp(z[0]) * base, persistence * share, persistence * (1 - share), math.exp(z[3])
    nu = 2.05 + extra
    n = len(q)

    def after(first: float, u: np.ndarray) -> np.ndarray:
        """n + 1 values: the first, and each b times the one before plus u."""
        return _decayed(np.concatenate([[first], u]), b)

    s = after(base, omega + a * q)
    by_omega, by_a, by_b = after(0.0, np.ones(n))[:n], after(0.0, q)[:n], after(0.0, s[:n])[:n]
    following, s = float(s[n]), s[:n]
    w = q / (s * (nu - 2))
    logs = np.log1p(w)
    constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    value = n * constant - 0.5 * np.log(s).sum() - (nu + 1) / 2 * logs.sum()
    by_s = (-0.5 + (nu + 1) / 2 * w / (1 + w)) / s
    by_nu = n * (0.5 * _digamma((nu + 1) / 2) - 0.5 * _digamma(nu / 2) - 0.5 / (nu - 2)) - 0.5 * logs.sum() + (nu + 1) / 2 * (w / (1 + w)).sum() / (nu - 2)
    g_omega, g_a, g_b = by_s @ by_omega, by_s @ by_a, by_s @ by_b
    moved = persistence * (1 - persistence)
    gradient = [g_omega * omega, (g_a * share + g_b * (1 - share)) * moved, (g_a - g_b) * persistence * share * (1 - share), by_nu * extra]
    return -float(value), -np.array(gradient), following


def garch_t(y: np.ndarray, steps: int = 200) -> tuple[dict[str, float], float] | None:
    """Maximum likelihood of a GARCH(1,1) with Student-t errors on the last FIT_MOST values by BFGS: (parameters, next variance).

    Parameters hold the record of the search too: log_likelihood, iterations, gradient (its greatest entry). None for fewer than FIT_LEAST
    values, or if the search comes to no rest in so many steps from any of its starts; of several the best optimum counts.
    """
    y = y[np.isfinite(y)][-FIT_MOST:] * 100
    if len(y) < FIT_LEAST or y.var() <= 0:
        return None
    y = y - y.mean()
    base, q = float(y.var()), y * y
    least, most = np.array([-16.0, -8.0, -8.0, -6.0]), np.array([3.0, 9.0, 8.0, 7.0])
    best = None
    for start in ((-3.0, 3.0, -2.0, 1.5), (-0.5, 0.0, 0.0, 1.5)):
        z = np.array(start)
        value, gradient, _ = garch_likelihood(z, q, base)
        inverse, rests = np.eye(4) / max(1.0, np.abs(gradient).max()), False
        for i in range(1, steps + 1):
            free = ~(((z <= least) & (gradient > 0)) | ((z >= most) & (gradient < 0)))  # at a bound and pushed on: it stays there
            if np.abs(gradient[free]).max(initial=0.0) < 1e-5 * (1 + abs(value)):
                rests = True
                break
            step = np.zeros(4)
            step[free] = -(inverse[np.ix_(free, free)] @ gradient[free])
            if step @ gradient >= 0:
                inverse, step = np.eye(4) / max(1.0, np.abs(gradient).max()), np.where(free, -gradient, 0.0) / max(1.0, np.abs(gradient).max())
            step *= min(1.0, 2.0 / np.abs(step).max(initial=1e-300))
            length = 1.0
            while length > 1e-10:
                to = np.clip(z + length * step, least, most)
                new, turned, _ = garch_likelihood(to, q, base)
                if new <= value + 1e-4 * (gradient @ (to - z)):
                    break
                length /= 2
            else:
                rests = np.abs(gradient[free]).max(initial=0.0) < 1e-3 * (1 + abs(value))  # rounding hides any further descent
                break
            d, g = to - z, turned - gradient
            if d @ g > 1e-12:
                rho, eye = 1 / (d @ g), np.eye(4)
                inverse = (eye - rho * np.outer(d, g)) @ inverse @ (eye - rho * np.outer(g, d)) + rho * np.outer(d, d)
            z, value, gradient = to, new, turned
        if rests and (best is None or value < best[0]):
            best = (value, z, i, float(np.abs(gradient).max()))
    if best is None:
        return None
    value, z, i, rest = best
    persistence, share = 1 / (1 + math.exp(-z[1])), 1 / (1 + math.exp(-z[2]))
    found = {"omega": math.exp(z[0]) * base / 1e4, "alpha[1]": persistence * share, "beta[1]": persistence * (1 - share), "nu": 2.05 + math.exp(z[3])}
    return found | {"log_likelihood": -value, "iterations": i, "gradient": rest}, garch_likelihood(z, q, base)[2] / 1e4


def garch_forecasts(series: DataFrame, by: list[str], value: str = "y", span: int = 24) -> DataFrame:
    """Per series the next volatility: GARCH-t, or EWMA (then degraded) where the fit has too little data or doesn't converge."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        y = f.sort_values("open_time")[value].dropna().to_numpy(float)
        got = garch_t(y)
        row = {k: f[k].iloc[0] for k in by}
        if got is None:
            v = float(pd.Series(y * y).ewm(span=span, adjust=False).mean().iloc[-1]) if len(y) else 0.0
            return pd.DataFrame([row | {"model": "ewma_fallback", "degraded": True, "volatility": math.sqrt(v), "alpha": None, "beta": None, "nu": None}])
        p, v = got
        return pd.DataFrame([row | {"model": "garch_t", "degraded": False, "volatility": math.sqrt(v), "alpha": p["alpha[1]"], "beta": p["beta[1]"], "nu": p["nu"]}])

    keys = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in by)
    return series.select(*by, "open_time", value).groupBy(*by).applyInPandas(run, f"{keys}, model string, degraded boolean, volatility double, alpha double, beta double, nu double")


def forecast_service(returns: DataFrame, every: int = 24) -> DataFrame:
    """garch_forecasts of each symbol and of BASKET, their mean, with refit_countdown: the bars until the next fit, one being due every `every` bars.

    returns: symbol, open_time, log_return.
    """
    each = returns.select("symbol", "open_time", F.col("log_return").alias("y"))
    market = each.groupBy("open_time").agg(F.avg("y").alias("y")).select(F.lit("BASKET").alias("symbol"), "open_time", "y")
    both = each.unionByName(market).where(F.col("y").isNotNull())
    left = both.groupBy("symbol").agg((every - 1 - (F.count("*") - 1) % every).cast("int").alias("refit_countdown"))
    return garch_forecasts(both, ["symbol"]).join(left, "symbol")


def selection_due(last: datetime | None, now: datetime, days: int = 7) -> bool:
    """Whether models are to be selected again: at first, and when the last selection is a week old."""
    return last is None or now - last >= timedelta(days=days)


def garch_fits(series: DataFrame, by: list[str], value: str = "y", every: int = 24) -> DataFrame:
    """by, refit (a value's index), volatility, alpha, beta, nu, iterations: the fits of a history, at most about REFITS for each series.

    A fit is due `every` values after the last one that succeeded, with FIT_LEAST values at least; one that fails has no volatility and is
    tried again at the next value. The last value always has a fit of its own. A task sees the values that these fits see, at most
    FIT_MOST + every * REFITS of a series, whatever its length.
    """
    points = indexed(series.withColumnRenamed(value, "y") if value != "y" else series, by)
    begin = F.greatest(F.lit(0), F.col("n") - every * REFITS)
    seen = points.where(F.col("i") > begin - FIT_MOST).select(*by, "i", "n", "y")
    names = [*by, "refit", "volatility", "alpha", "beta", "nu", "iterations"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        y, first, n = f["y"].to_numpy(float), int(f["i"].iloc[0]), int(f["n"].iloc[0])
        key, rows, due = [f[k].iloc[0] for k in by], [], max(0, n - every * REFITS, FIT_LEAST - 1)
        for pos in range(due, n):
            if pos < due and pos < n - 1:
                continue
            got = garch_t(y[: pos - first + 1])
            if got is None:
                rows.append((*key, pos, None, None, None, None, None))
            else:
                p, v = got
                rows.append((*key, pos, math.sqrt(v), p["alpha[1]"], p["beta[1]"], p["nu"], p["iterations"]))
                due = pos + every
        return pd.DataFrame(rows, columns=names)

    keys = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in by)
    return seen.groupBy(*by).applyInPandas(run, f"{keys}, refit int, volatility double, alpha double, beta double, nu double, iterations int")


def garch_history(series: DataFrame, fitted: DataFrame, by: list[str], value: str = "y", span: int = 24) -> DataFrame:
    """by, open_time, volatility, fitted: at each value the forecast of the last fit up to it; the EWMA before the first, where a fit failed, or if it is 0."""
    points = indexed(series.withColumnRenamed(value, "y") if value != "y" else series, by)
    smooth = ewma(points, "y", "_v", span, by, emit_from=1)
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tried = fitted.select(*by, F.col("refit").alias("i"), F.struct(F.when(F.col("volatility") > 0, F.col("volatility")).alias("v")).alias("_g"))
    at = points.join(tried, [*by, "i"], "left").withColumn("_g", F.last("_g", ignorenulls=True).over(w)["v"])
    out = at.join(smooth, [*by, "open_time"], "left")
    return out.select(*by, "open_time", F.coalesce("_g", F.sqrt("_v")).alias("volatility"), F.col("_g").isNotNull().alias("fitted"))
