"""The parameters of all analyses in one frozen object."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # The published defaults of the analyses.
    train_fraction: float = 0.8
    optimal_inventory_factor: float = 1.5
    forecast_horizon_days: int = 30
    season_length: int = 7
    order: tuple[int, ...] = (1, 1, 1)
    seasonal_order: tuple[int, ...] = (1, 1, 0, 7)
    min_fit_days: int = 30
    max_fit_steps: int = 50
    trees: int = 100
    max_depth: int = 15
    min_samples_split: int = 5
    seed: int = 42
    lead_time_days: int = 7
    service_level: float = 0.95
    ordering_cost: float = 50.0
    holding_cost_pct: float = 0.25
    elasticity_threshold: float = -1.0
    price_diff_bins: tuple[int, ...] = (-100, -10, -5, -2, 0, 2, 5, 10, 100)

    @classmethod
    def from_json(cls, path: str) -> Params:
        """Read the sections of a configuration file; missing keys keep their default."""
        with open(path) as handle:
            config = json.load(handle)
        where = {
            "train_fraction": ("data", "train_test_split"),
            "optimal_inventory_factor": ("eda", "supply_analysis", "optimal_inventory_factor"),
            "forecast_horizon_days": ("forecasting", "forecast_horizon_days"),
            "order": ("forecasting", "sarima_params", "order"),
            "seasonal_order": ("forecasting", "sarima_params", "seasonal_order"),
            "trees": ("forecasting", "ml_model", "n_estimators"),
            "max_depth": ("forecasting", "ml_model", "max_depth"),
            "min_samples_split": ("forecasting", "ml_model", "min_samples_split"),
            "lead_time_days": ("inventory_optimization", "lead_time_days"),
            "service_level": ("inventory_optimization", "service_level"),
            "ordering_cost": ("inventory_optimization", "ordering_cost"),
            "holding_cost_pct": ("inventory_optimization", "holding_cost_pct"),
            "elasticity_threshold": ("pricing_strategy", "elasticity_threshold"),
            "price_diff_bins": ("pricing_strategy", "price_diff_bins"),
        }
        found = {}
        for field, keys in where.items():
            node = config
            for key in keys:
                node = node.get(key) if isinstance(node, dict) else None
            if node is not None:
                found[field] = tuple(node) if isinstance(node, list) else node
        return replace(cls(), **found)


DEFAULTS = Params()
