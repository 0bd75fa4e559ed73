"""Profile, train and evaluate every series; estimate the holiday uplift; write what the pages read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shelfcast.names import DATE, KEYS
from shelfcast.operators import baselines, combine, evaluate, explain, features, learners, profile, series_fit, series_trees, uplift
from shelfcast.session import cut_lineage
from shelfcast.sources.sinks import save_model, write_table


def model_study(
    fact: DataFrame,
    stores: DataFrame,
    train_end: str,
    val_end: str,
    used: Sequence[str] | None = None,
    boosting: learners.Boosting = learners.BASIC,
    forest: learners.Forest = learners.SERIES_FOREST,
    hybrid_boosting: learners.Boosting = learners.HYBRID,
    fit_on: tuple[str, ...] = ("train",),
) -> dict[str, DataFrame]:
    """All models over all series that have enough history: predictions, league table, hybrid, importance.

    Every model of the league sees the same span (``fit_on``). The hybrid's learned model is fitted on the training part
    alone, whatever ``fit_on`` is, because the validation part decides whether it may be used. ``used`` are the features
    of the learned models; by default the base features and every search-interest column the fact has. The labelled
    weekly table is written once and read by everything else.
    """
    parts = cut_lineage(features.with_enough_history(features.label_split(fact, train_end, val_end), 50, features.SPLIT_MINIMA))
    used = list(used) if used else [*learners.MODEL_FEATURES, *combine.columns_containing(parts, "GoogleTrends")]
    bridge = "val" if "val" in fit_on else "train"
    learned = series_trees.series_models(parts, {"XGBoost": boosting, "Random Forest": forest}, used, fit_on, ensemble="Ensemble")

    predictions = combine.stack([
        baselines.baseline_forecasts(parts, history="full", bridge=bridge, mean_of=fit_on),
        learned.select(*KEYS, DATE, *baselines.PREDICTION_COLUMNS),
        series_fit.arima_forecast(parts, fit_on=fit_on),
        series_fit.seasonal_arima_forecast(parts, fit_on=fit_on),
        series_fit.trend_season_forecast(parts, fit_on=fit_on),
    ])
    described = profile.profile(fact)
    results = evaluate.league_table(predictions, stores)
    gate = series_trees.series_models(parts, {"XGBoost": hybrid_boosting}, used, ("train",), ("val", "test"))
    wide = learners.hybrid_wide(parts, gate.withColumnRenamed("Actual", "Weekly_Sales").drop("Model", "Trees"), described)
    hybrid = learners.hybrid_results(wide)
    importance = explain.with_store_type(series_trees.series_importance(parts, boosting, used, fit_on), stores)
    return {
        "profile": described,
        "predictions": predictions,
        "results": results,
        "hybrid_predictions": learners.hybrid_predictions(wide),
        "hybrid_results": hybrid,
        "comparison": evaluate.hybrid_comparison(hybrid, results),
        "importance": importance,
    }


def uplift_study(
    fact: DataFrame,
    nuisance: learners.Boosting = uplift.NUISANCE,
    forest: learners.Forest = uplift.CAUSAL_FOREST,
) -> dict[str, DataFrame]:
    """Causal uplift per row, its average with interval, rollups, and what drives it."""
    residuals = uplift.cross_fit_residuals(uplift.uplift_rows(fact), settings=nuisance)
    effects, model = uplift.causal_uplift(residuals, settings=forest)
    effects = cut_lineage(effects)
    rollups = uplift.uplift_rollups(effects)
    return {
        "uplift": effects.select(
            "Store", "Dept", "Date", *uplift.CONTROLS, "Weekly_Sales", "Holiday_Uplift", "Std_Error", "Lower", "Upper"
        ),
        "mean_interval": uplift.mean_interval(effects),
        "uplift_by_series": rollups.where("Level = 'Series'").drop("Level"),
        "uplift_rollups": rollups,
        "average_effect": uplift.average_effect(residuals, cluster="Store"),
        "uplift_importance": explain.model_importance(fact.sparkSession, model, uplift.CONTROLS),
    }


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{out.rstrip('/')}/{name}")


def keep_model(model, out: str, name: str) -> None:
    """Persist a fitted model for later scoring; ``load_pipeline`` brings it back."""
    save_model(model, f"{out.rstrip('/')}/models/{name}")
