"""Parameters of the strategy, the profiler and the simulated book."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values that results depend on.
    threshold_score: int = 65
    cap_unknown: int = 3
    cap_on: int = 2
    cap_off: int = 1
    min_avg_value: float = 1e8
    r20_gate: float = 30.0
    atr_bars: int = 14
    stop_floor: float = 0.05
    stop_ceiling: float = 0.08
    stop_multiple: float = 2.0
    target_multiple: float = 0.5
    far_target_multiple: float = 2.0
    max_hold: int = 10
    # A ticker without a bar counts as suspended after max_hold sessions: of the whole index ("parity"), or up to the day ("as_of").
    suspension_mode: str = "parity"
    max_positions: int = 3
    cash_share: float = 0.98
    lot: int = 100
    capital: float = 1e7
    history: int = 100
    min_bars: int = 20
    regime_bars: int = 200
    liquidity_days: int = 20
    window_days: int = 800
    # Arms: bars between the two closes of the 20-bar return, and whether the bar must be of the decision date.
    arms: tuple[tuple[str, int, bool], ...] = (("B0", 19, False), ("B1", 20, True))
    calendar_window: int = 60
    min_active_pct: float = 0.6
    stale_gap: int = 5
    missing_share: float = 0.20
    viol_count: int = 3
    viol_share: float = 0.002
    viol_tolerance: float = 1e-4
    flat_fee: float = 0.0040
    exact_buy: float = 0.00151303
    exact_sell: float = 0.00251303


FEE_PROFILES = ("PROD_FLAT", "AJAIB_EXACT")
BUCKETS = ("DATA_UNUSABLE", "INELIGIBLE", "FEATURE_INVALID", "MODEL_INVALID", "GATE_REJECTED", "QUALIFIED_NOT_SELECTED", "SELECTED")
PROFILE_STATUSES = ("PROFILE_OK", "DATA_UNUSABLE")
FRESHNESS_STATUSES = ("PROFILE_OK_FRESH", "PROFILE_OK_STALE_TAIL", "DATA_UNUSABLE")
EXIT_REASONS = ("TP_GAP", "SL_GAP", "STOP_LOSS", "TAKE_PROFIT_1", "TIME_EXIT", "TIME_EXIT_SUSPENDED")
