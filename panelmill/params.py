"""Parameter tables.

Fixed values: these numbers must equal the reference's calibration for the
results to be comparable. They are stated plainly, in the reference's order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELASTICITIES = {
    "wheat": {"supply": 0.45, "supply_se": 0.090, "demand": -0.32, "demand_se": 0.064},
    "rice": {"supply": 0.38, "supply_se": 0.076, "demand": -0.30, "demand_se": 0.060},
}
KAPPA = 0.15
SCENARIOS = [
    ("farmer_centric", 0.6, 0.2, 0.2, 0.0),
    ("consumer_centric", 0.2, 0.6, 0.2, 0.0),
    ("fiscal_conserv", 0.33, 0.33, 0.34, 0.0),
    ("equal_weights", 0.33, 0.33, 0.33, 0.0),
]
CURRENT_FLOOR = {"wheat": 2425.0, "rice": 2800.0}
PROCUREMENT = {"wheat": 26.64, "rice": 52.89}
PRODUCTION = {"wheat": 112.0, "rice": 137.0}
MC_DRAWS = 1000
MC_SEED = 2024
FORECAST_SD_FRACTION = 0.30
ETAS = [0.0, 0.5, 1.0, 2.0, 3.0]
STRESS = [
    ("Baseline", 1.0, 1.0),
    ("Low supply, low demand", 0.5, 0.5),
    ("High supply, high demand", 1.5, 1.5),
    ("Low supply, high demand", 0.5, 1.5),
    ("High supply, low demand", 1.5, 0.5),
]
HORIZONS = [("1-month", 30), ("3-month", 90), ("6-month", 180)]
PRICE_LAGS = [1, 2, 3, 7, 14, 30]
MOVING_WINDOWS = [7, 14, 30]
RF_PARAMS = {"num_trees": 200, "max_depth": 20, "min_samples_split": 10, "seed": 42}
GB_PARAMS = {"max_iter": 200, "max_depth": 8, "step_size": 0.1, "subsample": 0.8, "seed": 42}
SARIMA_ORDER = (1, 1, 1)
SARIMA_SEASONAL = (1, 1, 1, 7)
SEARCH_LOW, SEARCH_HIGH = -200.0, 1500.0
CONCAVITY_LOW, CONCAVITY_HIGH, CONCAVITY_POINTS = -500.0, 1500.0, 500
UNIT_SCALE = 10.0
FALLBACK_PRICE = {"wheat": 2350.0, "rice": 2967.0}
FALLBACK_RMSE = {"wheat": 241.62, "rice": 189.43}

# Binding of the test tables: split dates and folds of FIXTURES §2.
TRAIN_END = "1999-12-31"
TEST_START = "2001-01-01"
FOLDS = [
    (1, "1998-12-31", "1999-01-01", "1999-12-31"),
    (2, "1999-12-31", "2000-01-01", "2000-06-30"),
    (3, "2000-06-30", "2000-07-01", "2000-12-31"),
]

ARCHETYPES = ["wheat", "rice"]


def archetype_params(archetype: Column) -> Column:
    """Struct of the crop calibration for an archetype name column."""
    def pick(table):
        return (F.when(archetype == "wheat", F.lit(table["wheat"]))
                .otherwise(F.lit(table["rice"])))
    return F.struct(
        pick({k: v["supply"] for k, v in ELASTICITIES.items()}).alias("eps_s"),
        pick({k: v["supply_se"] for k, v in ELASTICITIES.items()}).alias("eps_s_se"),
        pick({k: v["demand"] for k, v in ELASTICITIES.items()}).alias("eps_d"),
        pick({k: v["demand_se"] for k, v in ELASTICITIES.items()}).alias("eps_d_se"),
        pick(PROCUREMENT).alias("q_proc"),
        pick(PRODUCTION).alias("q_total"),
        pick(CURRENT_FLOOR).alias("current_msp"),
    )
