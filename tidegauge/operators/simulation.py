"""Simulated runs: candidates refitted along a series, ranked and scored at each origin with nothing from later ones."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.intervals import bar_count, normalise_interval
from tidegauge.functions.scalars import EPS, EXPECTATION_LABELS, SEASONALITY_LABELS, VOLATILITY_LABELS, label, trend_label
from tidegauge.operators import lab

METHODS = ("bic_weighted_percentile", "aic_weighted_percentile", "equal_weighted", "best_qlike_model")
ORIGIN = ["symbol", "target", "origin"]


@dataclass(frozen=True)
class SimulationSpec:
    """A run's parameters, checked when it is made."""

    run_name: str
    symbols: tuple[str, ...]
    interval: str
    data_start: str
    data_end: str
    T: str
    dT: str
    S: str
    s_role: str = "seed"
    forecast_horizon_bars: int = 1
    target: str = "both"
    search_mode: str = "two_stage"
    scoring_method: str = "bic_weighted_percentile"
    model_groups: tuple[str, ...] = lab.FAMILIES
    candidate_limit: int = 16
    calibration_window: str = "30 bars"
    seed: int = 0
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.symbols:
            raise ValueError("at least one symbol is required")
        for name in ("T", "dT", "S"):
            if not str(getattr(self, name)).strip():
                raise ValueError(f"{name} is required")
        normalise_interval(self.interval)
        lab.targets(self.target)
        if self.scoring_method not in METHODS:
            raise ValueError(f"unknown scoring method: {self.scoring_method!r}")
        if self.forecast_horizon_bars < 1 or self.data_start >= self.data_end:
            raise ValueError("the horizon must be positive and the range must not be empty")
        self.t_bars, self.dt_bars  # noqa: B018  both must parse

    @property
    def t_bars(self) -> int:
        return bar_count(self.T, self.interval)

    @property
    def dt_bars(self) -> int:
        return bar_count(self.dT, self.interval)

    @classmethod
    def from_mapping(cls, m: dict) -> SimulationSpec:
        known = {k: v for k, v in m.items() if k in cls.__dataclass_fields__}
        symbols = m.get("symbols", ())
        names = symbols.split(",") if isinstance(symbols, str) else symbols
        known["symbols"] = tuple(dict.fromkeys(s.strip().upper() for s in names if s.strip()))
        if isinstance(known.get("model_groups"), (str, list)):
            g = known["model_groups"]
            known["model_groups"] = tuple(x.strip() for x in (g.split(",") if isinstance(g, str) else g))
        return cls(**known)

    def to_dict(self) -> dict:
        return asdict(self)


def steps(series: DataFrame, chosen: list[lab.Spec], t_bars: int, horizon: int, dt_bars: int) -> DataFrame:
    """A row per symbol, target, origin and candidate. series: symbol, target, open_time, y."""
    points = lab.indexed(series, ["symbol", "target"])
    origins = lab.origin_frame(points, ["symbol"], t_bars, horizon, dt_bars, simulation=True)
    fitted = lab.fits(points, chosen, ["symbol"], origins, t_bars, horizon)
    return rank_steps(lab.with_losses(fitted, squared_change=True))


def rank_steps(rows: DataFrame) -> DataFrame:
    """Adds rank (dense, by QLIKE) and the composite score at each origin."""
    n = F.count("*").over(Window.partitionBy(*ORIGIN))
    score = F.when(F.col("converged"), 0).otherwise(n)
    for metric, weight in (("aic", 1), ("bic", 1), ("hqic", 1), ("qlike", 2), ("rmse_loss", 1), ("mae_loss", 1)):
        score = score + weight * lab.dense_rank_or_last(metric, ORIGIN)
    return rows.withColumn("rank", lab.dense_rank_or_last("qlike", ORIGIN)).withColumn("composite_rank_score", score.cast("double"))


def _by_ordinal(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ordinals.select("candidate", "ordinal")), "candidate")


def weights(rows: DataFrame, method: str = "bic_weighted_percentile") -> DataFrame:
    """Adds weight, a candidate's share at its origin; rows need ordinal, to break ties."""
    if method not in METHODS:
        raise ValueError(f"unknown scoring method: {method!r}")
    at = Window.partitionBy(*ORIGIN)
    usable = rows.where("forecast_volatility is not null")
    equal = 1.0 / F.count("*").over(at)
    if method == "equal_weighted":
        return usable.withColumn("weight", equal)
    if method == "best_qlike_model":
        first = F.row_number().over(at.orderBy(F.asc_nulls_last("qlike"), "ordinal"))
        return usable.withColumn("weight", F.when(first == 1, 1.0).otherwise(0.0))
    metric = "aic" if method == "aic_weighted_percentile" else "bic"
    x = F.when(F.col("converged"), F.col(metric))
    raw = F.exp(-0.5 * F.least(F.greatest(x - F.min(x).over(at), F.lit(0.0)), F.lit(700.0)))
    total = F.sum("_w").over(at)
    return usable.withColumn("_w", raw).withColumn("weight", F.when(F.count("_w").over(at) > 0, F.coalesce(F.col("_w") / total, F.lit(0.0))).otherwise(equal)).drop("_w")


def percentile_rank(history: Column, value: Column) -> Column:
    """Share of the history at or below the value, equal ones counted half more; a half without history."""
    below = F.size(F.filter(history, lambda v: v <= value)) + 0.5 * F.size(F.filter(history, lambda v: v == value))
    return F.when((F.size(history) > 0) & value.isNotNull(), below / F.size(history)).otherwise(0.5)


def score_origins(rows: DataFrame, method: str = "bic_weighted_percentile", missing_rate: float = 0.0) -> DataFrame:
    """One row per symbol, target and origin: scores, labels, confidences and the selected model.

    Forecasts are compared with the same candidate's converged forecasts at earlier origins only.
    """
    before = Window.partitionBy("symbol", "target", "candidate").orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)
    at = Window.partitionBy(*ORIGIN)
    vol, mu = F.col("forecast_volatility"), F.coalesce("forecast_mean", F.lit(0.0))
    told = rows.withColumn("history", F.collect_list(F.when(F.col("converged"), vol)).over(before)).withColumn("rate", F.avg(F.col("converged").cast("double")).over(at))
    w = weights(told, method)
    sigma = F.greatest(vol, F.lit(EPS))
    boost = F.when(F.col("family").isin("trend", "combined"), 1.25).otherwise(1.0)
    seasonal = F.col("model_id").contains("season") | F.col("model_id").contains("stl")
    baseline = F.min(F.when(F.col("model_id").isin("naive_mean", "constant_mean"), F.col("bic"))).over(at)
    gain = F.when(seasonal, F.when(F.col("bic").isNotNull() & baseline.isNotNull(), F.greatest(F.lit(0.0), baseline - F.col("bic"))).when(F.col("converged"), 1.0))
    w = w.withColumn("_gain", gain)
    positive = F.col("weight") > 0
    total = F.greatest(F.sum("weight"), F.lit(EPS))
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    chosen = F.struct(-F.col("weight"), "ordinal")
    mean_vol, spread = F.avg(F.when(positive, vol)), F.stddev_pop(F.when(positive, vol))
    agreement = F.when(F.count(F.when(positive, vol)) <= 1, 0.65).when(mean_vol <= EPS, 0.5).otherwise(clamp(1 / (1 + spread / F.greatest(mean_vol, F.lit(EPS))), 0, 1))
    out = w.groupBy(*ORIGIN, "origin_time").agg(
        *(F.min_by(c, chosen).alias(f"selected_{c}") for c in ("candidate", "model_id", "family", "aic", "bic", "hqic", "qlike", "forecast_volatility", "realized_volatility", "forecast_mean", "realized_return")),
        F.bround(clamp(100 * F.sum(F.col("weight") * percentile_rank(F.col("history"), vol)), 0, 100), 0).cast("int").alias("volatility_score"),
        clamp(F.sum(F.col("weight") * (50 + 50 * F.tanh(mu / sigma))) / total, 0, 100).alias("expectation_score"),
        clamp(F.sum(F.col("weight") * 100 * F.tanh(boost * mu / sigma)) / total, -100, 100).alias("trend_score"),
        F.coalesce(100 * (1 - F.exp(-F.avg("_gain") / 10)), F.lit(0.0)).alias("seasonality_score"),
        agreement.alias("_a"), F.max("rate").alias("_r"), F.least(F.lit(1.0), F.max(F.size("history")) / 10).alias("_c"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(positive, F.struct("candidate", F.bround("weight", 6).alias("w")))))).alias("model_weights"),
        F.array_sort(F.collect_set(F.when(F.size("history") < 5, F.concat("candidate", F.lit(": few earlier forecasts"))))).alias("warnings"),
    )
    missing = max(0.0, 1.0 - min(1.0, missing_rate * 2.0))
    out = out.withColumn("confidence", clamp(0.30 + 0.25 * F.col("_r") + 0.20 * F.col("_a") + 0.15 * F.col("_c") + 0.10 * missing, 0, 1)).drop("_a", "_r", "_c")
    return out.select(
        "*",
        label(F.col("volatility_score"), VOLATILITY_LABELS).alias("volatility_label"), label(F.col("expectation_score"), EXPECTATION_LABELS).alias("expectation_label"),
        trend_label(F.col("trend_score")).alias("trend_label"), label(F.col("seasonality_score"), SEASONALITY_LABELS).alias("seasonality_label"),
        clamp(F.col("confidence") * 0.82, 0, 1).alias("expectation_confidence"), clamp(F.col("confidence") * 0.88, 0, 1).alias("trend_confidence"),
        clamp(F.col("confidence") * F.when(F.col("seasonality_score") > 0, 0.75).otherwise(0.55), 0, 1).alias("seasonality_confidence"),
    )


def model_evaluation(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means per candidate; stability is 1 / (1 + population deviation of its ranks)."""
    by = by or []
    return rows.groupBy(*by, "candidate").agg(
        F.count("*").alias("origin_count"), F.avg(F.col("converged").cast("double")).alias("convergence_rate"),
        *(F.avg(c).alias(f"avg_{c}") for c in ("aic", "bic", "hqic", "qlike")), F.avg("rmse_loss").alias("rmse"), F.avg("mae_loss").alias("mae"),
        F.when(F.count("rank") > 1, 1 / (1 + F.stddev_pop("rank"))).otherwise(1.0).alias("rank_stability"), F.avg("composite_rank_score").alias("composite_rank_score"),
    )


def metric_series(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """symbol, target, candidate, metric, time, value: the run's metrics, unpivoted."""
    long = rows.select("symbol", "target", "candidate", F.col("origin_time").alias("time"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x"))
    return long.select("symbol", "target", "candidate", "time", "x.metric", "x.value")


def conclusion(scores: DataFrame) -> DataFrame:
    """Per symbol and target the latest scores, with a headline."""
    w = Window.partitionBy("symbol", "target").orderBy(F.desc("origin"))
    latest = scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return latest.withColumn("headline", F.concat_ws(", ", "symbol", F.concat(F.lit("volatility "), F.col("volatility_score").cast("string")), F.concat(F.lit("model "), F.col("selected_candidate"))))


def residual_diagnostics(windows: DataFrame, values: str) -> DataFrame:
    """Adds n, variance and lag-1 correlation of an array of training values."""
    a = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    centred = lambda v: F.transform(F.array(total(v) / F.size(v)), lambda mean: F.transform(v, lambda e: e - mean))[0]
    dot = lambda p, q: total(F.zip_with(p, q, lambda e, f: e * f))
    n = F.size("_a")
    p, q = centred(F.slice("_a", F.lit(1), F.greatest(n - 1, F.lit(0)))), centred(F.slice("_a", F.lit(2), F.greatest(n - 1, F.lit(0))))
    spread = F.sqrt(dot(p, p) * dot(q, q))
    out = windows.withColumn("_a", a)
    c = centred(F.col("_a"))
    return out.withColumns({
        "residual_n": n, "residual_variance": F.when(n >= 4, dot(c, c) / (n - 1)),
        "residual_autocorr": F.when((n >= 4) & (spread > 0), dot(p, q) / F.nullif(spread, F.lit(0.0))),
    }).drop("_a")


def run(candles_series: DataFrame, spec: SimulationSpec, missing_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(steps, scores) of a run. candles_series: symbol, target, open_time, y."""
    chosen = lab.specs(list(spec.model_groups), spec.target, spec.candidate_limit)
    wanted = candles_series.where(F.col("symbol").isin(list(spec.symbols)) & F.col("target").isin(lab.targets(spec.target)))
    rows = steps(wanted, chosen, spec.t_bars, spec.forecast_horizon_bars, spec.dt_bars)
    rows = _by_ordinal(rows, lab.specs_frame(candles_series.sparkSession, chosen))
    return rows, score_origins(rows, spec.scoring_method, missing_rate)
