"""Settings of every operator. Plain values live here so that plans carry them as literals."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: quality statuses, worst last -----------------------------------------
STATUSES = ("pass", "degraded", "quarantined")

# --- fixed values: day types and their numeric codes ------------------------------------
DAY_TYPE_CODES = {"business_day": 0, "weekend": 1, "holiday": 2, "declared_closure": 3}

# --- fixed values: evidence layers -------------------------------------------------------
LAYERS = ("domain_rule", "ml_ensemble", "stl_residual")

# --- fixed values: numeric features in vector order -------------------------------------
BASE_FEATURES = (
    "rolling_baseline_kwh",
    "peak_offpeak_split",
    "after_hours_kwh_ratio",
    "weekend_floor_load",
    "rolling_efficiency_ratio",
    "stl_residual_magnitude",
    "day_type_encoded",
)

SCHEMA_VERSION = "normalized_reading_v1"
NORMALIZATION_VERSION = "v1.0.0"
FEATURE_SCHEMA_VERSION = "feature_set_v1"


@dataclass(frozen=True)
class StuckRule:
    variance: float = 1e-6
    window: int = 6
    hours: int = 6


# fixed values: stuck-sensor thresholds per circuit type
STUCK_RULES = {
    "main_feed": StuckRule(1e-6, 6, 4),
    "hvac": StuckRule(1e-5, 6, 6),
    "lighting": StuckRule(1e-5, 8, 8),
    "plug_load": StuckRule(1e-4, 8, 12),
}

# fixed values: expected minutes between raw readings per ingestion source
EXPECTED_MINUTES = {"smart_meter_api": 15, "csv_upload": 60, "batch_upload": 60}

# fixed values: plausible kWh per hour, (min, max) per circuit type
BUILT_IN_BOUNDS = {
    "main_feed": (0.0, 5000.0),
    "hvac": (0.0, 2000.0),
    "lighting": (0.0, 500.0),
    "plug_load": (0.0, 200.0),
}
DEFAULT_BOUNDS = (0.0, 5000.0)


@dataclass(frozen=True)
class GateConfig:
    outlier_z: float = 3.0
    outlier_window: int = 24
    max_gap_minutes: int = 120
    max_fill_ratio: float = 0.10
    gap_fill: str = "linear"  # "none" leaves short gaps empty
    legacy_grid: bool = False  # True drops a last hour whose only stamp is on the hour
    stuck_rules: dict = field(default_factory=lambda: dict(STUCK_RULES))
    stuck_default: StuckRule = StuckRule()
    expected_minutes: dict = field(default_factory=lambda: dict(EXPECTED_MINUTES))
    expected_default: int = 60
    dropout_factor: float = 3.0


@dataclass(frozen=True)
class FeatureConfig:
    window_hours: int = 168
    peak_first: int = 9
    peak_last: int = 20
    open_hour: int = 8
    close_hour: int = 18


@dataclass(frozen=True)
class StlConfig:
    period: int = 24
    min_observations: int = 48
    seasonal: int = 35
    z_threshold: float = 3.0
    inner_passes: int = 2
    outer_passes: int = 15


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 100
    sample: int = 256
    contamination: float = 0.05
    by_building_type: dict = field(default_factory=dict)
    seed: int = 42
    shard_rows: int = 100_000


@dataclass(frozen=True)
class WindowModelConfig:
    window: int = 24
    hidden: tuple = (64, 32)
    latent: int = 8
    epochs: int = 50
    batch: int = 32
    rate: float = 1e-3
    percentile: float = 0.95
    seed: int = 42
    shard_rows: int = 50_000
    rounds: int = 5


@dataclass(frozen=True)
class ConfidenceConfig:
    min_labels: int = 30
    max_labels: int = 500
    level: float = 0.9


@dataclass(frozen=True)
class DriftConfig:
    alpha: float = 0.05
    min_points: int = 10
    overrides: dict = field(default_factory=dict)  # "type:zone" or "type:default" -> (alpha, min_points)
    days: int = 30
    block_rows: int = 65_536  # positions that one task counts


@dataclass(frozen=True)
class PromotionConfig:
    min_samples: int = 50
    max_anomaly_rate: float = 0.25
    reviewed_promotions: int = 3


@dataclass(frozen=True)
class RollbackConfig:
    max_fp_rate: float = 0.3
    min_labels: int = 10
    days: int = 7


@dataclass(frozen=True)
class ScenarioConfig:
    window_days: int = 30
    peak_rate: float = 9.5
    offpeak_rate: float = 6.0
    peak_first: int = 9
    peak_last: int = 18
    carbon: float = 0.71
    shiftable: float = 0.4
    per_degree: float = 0.03
    max_delta_c: float = 2.0
    panel_efficiency: float = 0.18
    performance_ratio: float = 0.75
    kw_per_sqm: float = 0.15
    capex_per_kw: float = 45000.0
    min_pct: float = 0.0
    max_pct: float = 60.0
    max_payback: float = 120.0


# fixed values: |latitude| upper edge -> kWh per square metre and day
IRRADIANCE_BANDS = ((15.0, 5.6), (23.0, 5.2), (30.0, 4.8), (90.0, 4.2))

# fixed values: rules whose findings justify shifting load
LOAD_TIMING_RULES = ("hvac_after_hours_v3", "scheduling_violation_v1", "weekend_vampire_load_v1")

RETRAIN_AT_LABELS = 5
RETRAIN_EVERY_DAYS = 30
TRAINING_DAYS = 90
ANALYSIS_DAYS = 30
