"""Fixed values of the cost model and scoring rules.

These values must equal the reference's for the results to match; they are
stated here together, in natural order, as plain constants.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PricingPolicy:
    # Pricing calibration of the annual gross estimate.
    winsor_low_q: float = 0.01
    winsor_high_q: float = 0.95
    ratio_min: float = 0.50
    ratio_max: float = 12.00
    blend_weight: float = 0.35
    annual_abs_max: float = 25000.0


@dataclass(frozen=True)
class CostPolicy:
    # Insulin cap per 30-day month, fallback per-fill charge,
    # distance penalties and the distance trade-off rule.
    insulin_cap_per_month: float = 35.0
    fallback_per_fill: float = 20.0
    penalty_far_miles: float = 15.0
    penalty_far: float = 200.0
    penalty_mid_miles: float = 8.0
    penalty_mid: float = 100.0
    tradeoff_oop_below: float = 2000.0
    tradeoff_miles_above: float = 12.0
    # defaults for missing beneficiary / pair attributes
    default_risk: str = "MED"
    default_unique_drugs: int = 3
    default_fills_target: int = 12
    default_total_rx_cost: float = 5000.0
    default_distance_miles: float = 10.0
    default_distance_category: str = "nearby"


PRICING = PricingPolicy()
COST = CostPolicy()

# Earth radius in miles (app / notebook variants) and km->mile.
EARTH_RADIUS_MILES = 3959.0
EARTH_RADIUS_MILES_NB = 3958.8
EARTH_RADIUS_KM = 6371.0
KM_TO_MILES = 0.621371

# Risk segments by total annual drug cost.
RISK_LOW_MAX = 2000.0
RISK_MED_MAX = 5000.0

# Relevance labels are rescaled to at most this grade.
MAX_RELEVANCE_LABEL = 30
