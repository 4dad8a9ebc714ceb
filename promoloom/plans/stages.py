"""The five analysis stages, each a few operator calls over given tables.

A stage returns named DataFrames; nothing is printed or written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..columns import DEFAULTS, Settings
from ..operators import causal, goldranks, interference, planning, pricing, rankeval, retrieval
from ..operators.embedding import attach_components, encode_names, name_components
from ..operators.features import add_features, controls_for
from ..operators.nuisance import Nuisance
from ..operators.panel import build_catalog
from ..storage import settle


def pricing_stage(sales: DataFrame, price_list: DataFrame,
                  settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    table = settle(pricing.build_price_table(sales, price_list, settings.price_bounds))
    priced = settle(pricing.price_per_kg(price_list, settings.price_bounds))
    return {"table": table, "by_product": pricing.price_by_product(priced),
            "coverage": pricing.price_coverage(table)}


def search_stage(sales: DataFrame | None, promo: DataFrame | None, queries: DataFrame,
                 rules: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Rank by all five methods, score them against the gold rules, test the differences."""
    catalog = settle(build_catalog(sales, promo))
    docs, asked = encode_names(retrieval.describe(catalog), retrieval.describe(queries, "text"))
    docs = settle(docs)
    gold = settle(rankeval.gold_documents(rules, docs))
    asked = settle(rankeval.queries_with_gold(asked, gold))
    ranks = goldranks.all_gold_ranks(asked, docs, gold, settings.pool)
    metrics = settle(rankeval.rank_metrics(ranks, gold, settings.k, goldranks.METHODS))
    return {"catalog": catalog, "metrics": metrics, "summary": rankeval.method_summary(metrics),
            "friedman": rankeval.friedman(metrics, 5), "mean_ranks": rankeval.mean_ranks(metrics),
            "nemenyi": rankeval.nemenyi(metrics, 5)}


def all_rankings(queries: DataFrame, docs: DataFrame, pool: int = DEFAULTS.pool) -> DataFrame:
    parts = [retrieval.category_all(queries, docs), retrieval.lexical_all(queries, docs),
             retrieval.structured_all(queries, docs), retrieval.dense_all(queries, docs),
             retrieval.rerank_all(queries, docs, pool)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def interference_stage(panel: DataFrame, catalog: DataFrame,
                       settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    pressure = settle(interference.substitute_pressure(panel, catalog))
    return {"pressure": pressure,
            "within": interference.within_effect(pressure, settings.within_reps, settings.seed),
            "fixed_effects": interference.fixed_effects(pressure),
            "dml": interference.dml_pressure(pressure)}


def effect_stage(panel: DataFrame, catalog: DataFrame | None = None,
                 settings: Settings = DEFAULTS, kind: str = "linear") -> dict[str, DataFrame]:
    """Effect of discount depth; with a catalog, name components join the controls."""
    features = add_features(panel, settings.lags)
    controls = controls_for(settings.lags)
    if catalog is not None:
        parts = settle(name_components(catalog, settings.embedding_dims))
        features = attach_components(features, parts)
        controls = controls + tuple(c for c in parts.columns if c.startswith("emb_"))
    features = settle(features)
    nuisance = Nuisance(kind, controls=controls)
    rows = causal.design(features, nuisance, folds=settings.folds, seed=settings.seed)
    overall = settle(causal.effect(rows, nuisance))
    curves = causal.response_curves(rows, nuisance, settings.boot_reps, settings.curve_grid,
                                    settings.hinge_knots)
    outcome = Nuisance(kind, controls=controls + ("own_disc",))
    return {"share": causal.treated_share(rows), "overall": overall,
            "by_category": causal.effect_by_category(rows, nuisance, settings.min_rows,
                                                     settings.min_treated),
            "curve": causal.dose_response(overall, curves),
            "inverse": causal.inverse_discount(curves, settings.inverse_targets),
            "conformal": causal.split_conformal(features, outcome, settings.test_months),
            "placebo": causal.placebo(rows, nuisance, settings.seed)}


def planning_stage(panel: DataFrame, price_table: DataFrame, settings: Settings = DEFAULTS,
                   kind: str = "linear", method: str = "greedy") -> dict[str, DataFrame]:
    """Plan under the history's own spend, and its comparison with history."""
    priced = settle(planning.attach_prices(panel, price_table))
    nuisance = Nuisance(kind, controls=controls_for(settings.lags))
    rows = causal.design(add_features(priced, settings.lags), nuisance, folds=settings.folds,
                         seed=settings.seed)
    overall = settle(causal.effect(rows, nuisance))
    by_category = settle(causal.effect_by_category(rows, nuisance, settings.min_rows,
                                                   settings.min_treated))
    base = settle(planning.baseline_table(priced))
    cand = settle(planning.candidates(base, by_category, overall, settings.grid, settings.cost_share))
    past = settle(planning.past_policy(priced, base, by_category, overall, settings.cost_share))
    budget = past.first()["hist_spend"]
    limits = (settings.slots, settings.kmax, settings.robust)
    if method == "greedy":
        plan = planning.greedy_plan(cand, budget, *limits)
    else:
        plan, _ = planning.lagrangian_plan(cand, budget, *limits)
    return {"base": base, "candidates": cand, "past": past, "plan": plan,
            "report": planning.plan_report(plan, past)}
