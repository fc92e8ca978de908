"""Portfolio tables: one row per asset and the views over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.config import ANOMALY_STATUSES, ScoreConfig
from fieldspark.functions.columns import deviation_pct, severity
from fieldspark.operators import scoring
from fieldspark.operators.quantiles import group_percentiles
from fieldspark.operators.ranking import global_rank

FLAG_FLOOR = 0.5


def assets_view(assets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Registered assets with catalogue attributes where there are any; default name '<field> <id>'."""
    joined = assets.join(catalogue, "asset_id", "left")
    return joined.withColumn("name", F.coalesce("name", F.concat_ws(" ", "field_name", "asset_id")))


def history_tail(df: DataFrame, n: int = 24, time_col: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    """The latest n rows per asset. The limit is applied in the map tasks before the shuffle."""
    newest = Window.partitionBy("asset_id").orderBy(F.col(time_col).desc(), *[F.col(c).desc() for c in ties])
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def latest_state(scored: DataFrame) -> DataFrame:
    """One row per asset: the last period with its own score, and the score of the last flagged period (0 if none)."""
    now = F.max(F.struct("period", "t", "actual", "expected", "dev_fraction", "change_rate", "anomaly_score"))
    flagged = F.max(F.when(F.col("anomaly_score") >= FLAG_FLOOR, F.struct("period", "anomaly_score", "dev_fraction", "change_rate")))
    out = scored.groupBy("asset_id").agg(
        now.alias("n"), flagged.alias("f"), F.count_if(F.col("anomaly_score") >= FLAG_FLOOR).cast("int").alias("n_windows"))
    out = out.select(
        "asset_id", "n.period", "n.t", "n.actual", "n.expected", "n.dev_fraction", "n.change_rate",
        F.col("n.anomaly_score").alias("current_score"), F.coalesce("f.anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.col("f.period").alias("flagged_period"), F.col("f.dev_fraction").alias("flagged_dev_fraction"),
        F.col("f.change_rate").alias("flagged_change_rate"), "n_windows")
    return out.withColumns({
        "deviation_pct": deviation_pct(F.col("actual"), F.col("expected")), "severity": severity(F.col("anomaly_score"))})


def score_assets(state: DataFrame, assets: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """State + asset attributes -> recovery, priority score, warnings, financials and recommendations."""
    held = state.join(assets, "asset_id", "left").withColumn("complexity", scoring.complexity(F.col("intervention_cost")))
    return scoring.recommend(scoring.financials(scoring.priority_score(scoring.recovery(held, config), config)))


def rank_assets(scored: DataFrame) -> DataFrame:
    return global_rank(scored, [F.col("score").desc(), F.col("asset_id").asc()], "rank")


def leaderboard(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "rank", "asset_id", "field_name", "basin", "status", F.round(F.col("actual") / 1000.0, 3).alias("current_k"),
        F.round(F.col("expected") / 1000.0, 3).alias("expected_k"), F.round("deviation_pct", 2).alias("deviation_pct"),
        "severity", F.round("anomaly_score", 3).alias("anomaly_score"), F.round("score", 1).alias("score"), "priority",
        F.round("recovery_volume", 6).alias("recovery_volume"))


def filter_leaderboard(board: DataFrame, search: str = "", priorities: Sequence[str] = (), basins: Sequence[str] = (),
                       severities: Sequence[str] = (), min_deviation: float | None = None,
                       min_recovery: float | None = None) -> DataFrame:
    out = board
    if search:
        text = search.lower()
        out = out.where(F.lower("asset_id").contains(text) | F.lower("field_name").contains(text) | F.lower("basin").contains(text))
    for col, wanted in (("priority", priorities), ("basin", basins), ("severity", severities)):
        if wanted:
            out = out.where(F.col(col).isin(*wanted))
    if min_deviation is not None:
        out = out.where(F.abs("deviation_pct") >= min_deviation)
    if min_recovery is not None:
        out = out.where(F.col("recovery_volume") >= min_recovery)
    return out


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 10) -> DataFrame:
    """Page `number` (from 1) of the sorted table; a top-k plan, not a full sort."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.lit(1)).alias("pages"))


def portfolio_summary(scored: DataFrame) -> DataFrame:
    active = F.col("status") == "ACTIVE"
    now, want = F.sum(F.when(active, F.col("actual"))), F.sum(F.when(active, F.col("expected")))
    return scored.agg(
        F.count(F.lit(1)).alias("total_assets"), F.count_if(active).alias("active_assets"),
        F.count_if(active & (F.col("anomaly_score") >= 0.5)).alias("at_risk_assets"),
        F.round(now / 1000.0, 2).alias("current_k"), F.round(want / 1000.0, 2).alias("expected_k"),
        F.round((now - want) / F.greatest(want, F.lit(1e-9)) * 100.0, 2).alias("deviation_pct"))


def top_anomalies(scored: DataFrame, n: int = 4) -> DataFrame:
    """The n active assets with the highest score and at least one flagged period."""
    return scored.where((F.col("status") == "ACTIVE") & (F.col("n_windows") > 0)).orderBy(
        F.col("anomaly_score").desc(), "asset_id").limit(n)


def portfolio_trend(panel: DataFrame, months: int = 12) -> DataFrame:
    """Last months of summed actual and expected, in thousands."""
    sums = panel.groupBy("period").agg(
        F.round(F.sum("actual") / 1000.0, 2).alias("actual_k"), F.round(F.sum("expected") / 1000.0, 2).alias("expected_k"))
    return sums.orderBy(F.col("period").desc()).limit(months)


def breakdown(scored: DataFrame, by: Sequence[str] = ("basin", "field_name")) -> DataFrame:
    """Totals per group, per leading group, and overall (NULL keys)."""
    return scored.rollup(*by).agg(
        F.count(F.lit(1)).alias("assets"), F.sum("actual").alias("actual"), F.sum("expected").alias("expected"),
        F.avg("score").alias("mean_score"), F.sum("recovery_volume").alias("recovery_volume"),
        F.count_if(F.col("severity") != "NORMAL").alias("flagged"))


def intervention_effect(df: DataFrame, by: Sequence[str] = (), exact: str = "bracket") -> DataFrame:
    """Predicted against actual recovery: success rate, share within 20 %, and the share of all recovery captured by the
    fifth with the highest prediction."""
    by = list(by)
    top = group_percentiles(df, by, "predicted", {"_p80": 0.8}, exact).drop("n")
    if by:
        held = df.join(top, by)
    else:
        held = df.withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    close = F.abs(F.col("actual") - F.col("predicted")) <= 0.2 * F.abs(F.col("predicted"))
    gain = F.when(F.col("predicted") >= F.col("_p80"), F.col("actual")).otherwise(0.0)
    return held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg("actual").alias("mean_actual"),
        (F.count_if("success") / F.nullif(F.count("success"), F.lit(0))).alias("success_rate"),
        (F.count_if(close) / F.count(F.lit(1))).alias("hit_rate"),
        F.try_divide(F.sum(gain), F.sum("actual")).alias("top_fifth_capture"))


def sources_view(sources: DataFrame, notes: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """All sources in order; `provenance_note` is the caller's text for the source type, if there is one."""
    note = F.lit(None).cast("string")
    for kind, text in notes.items():
        note = F.when(F.col("source_type") == kind, text).otherwise(note)
    return sources.withColumn("provenance_note", note).orderBy("source_type", "source_name", "dataset_name")


def models_view(models: DataFrame, code: str | None = None, name: str | None = None) -> DataFrame:
    """All registered models, one by code, or those whose name contains a text (any case)."""
    out = models
    if code is not None:
        out = out.where(F.col("code") == code)
    if name is not None:
        out = out.where(F.lower("model_name").contains(name.lower()))
    return out.orderBy("code")


def validate_models(models: DataFrame) -> DataFrame:
    """Adds `valid` and `reason` from the stored columns alone."""
    reason = (F.when(F.coalesce(F.col("status"), F.lit("")) != "ACTIVE", F.concat(F.lit("status is "), F.coalesce("status", F.lit("unknown"))))
              .when(F.col("training_date").isNull(), "never trained")
              .when(F.col("metric_count") <= 0, "no metrics").otherwise("ok"))
    return models.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")


def asset_detail(scored: DataFrame, panel: DataFrame, months: int = 24) -> DataFrame:
    """Scored assets with their last months as a bounded array."""
    tail = history_tail(panel.select("asset_id", "period", "actual", "expected"), months, "period")
    packed = tail.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("period", "actual", "expected"))).alias("history"))
    return scored.join(packed, "asset_id", "left")


def apply_status_events(anomalies: DataFrame, events: DataFrame, keys: Sequence[str] = ("asset_id", "period"),
                        order: Sequence[str] = ("event_ts",)) -> tuple[DataFrame, DataFrame]:
    """(anomalies with their latest valid status, rejected events)."""
    valid = F.coalesce(F.col("status").isin(*ANOMALY_STATUSES), F.lit(False))
    last = events.where(valid).groupBy(*keys).agg(F.max(F.struct(*order, "status")).alias("_l")).select(
        *keys, F.col("_l.status").alias("_status"))
    base = F.col("status") if "status" in anomalies.columns else F.lit("UNACKNOWLEDGED")
    out = anomalies.join(last, list(keys), "left").withColumn("status", F.coalesce("_status", base)).drop("_status")
    return out, events.where(~valid)
