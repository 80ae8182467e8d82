"""Strategy parameters and the typed schemas of all tables."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

class ConfigError(ValueError):
    """Parameters that contradict one another."""


class DataError(ValueError):
    """Input that a run must not continue with."""


@dataclass(frozen=True)
class Config:
    """All parameters of a run; checked when made."""

    hedge_window: int = 60
    zscore_window: int = 60
    entry: float = 2.0
    exit: float = 0.5
    stop: float = 3.5
    max_holding: int = 60
    commission_bps: float = 1.0
    slippage_bps: float = 2.0
    capital: float = 100_000.0
    fraction: float = 0.25
    bars_per_year: float = 252.0
    risk_free: float = 0.04
    cash_interest: bool = True

    def __post_init__(self) -> None:
        finite = math.isfinite
        rules = (
            (self.hedge_window >= 3, "hedge_window must be at least 3"),
            (self.zscore_window >= 2, "zscore_window must be at least 2"),
            (finite(self.entry) and self.entry > 0, "entry must be positive"),
            (finite(self.exit) and self.exit >= 0, "exit must not be negative"),
            (self.exit < self.entry, "exit must be below entry"),
            (self.stop > self.entry, "stop must be above entry"),
            (self.max_holding >= 1, "max_holding must be at least 1"),
            (finite(self.commission_bps) and self.commission_bps >= 0, "commission_bps must not be negative"),
            (finite(self.slippage_bps) and self.slippage_bps >= 0, "slippage_bps must not be negative"),
            (finite(self.capital) and self.capital > 0, "capital must be positive"),
            (0 < self.fraction <= 1, "fraction must be in (0, 1]"),
            (finite(self.bars_per_year) and self.bars_per_year > 0, "bars_per_year must be positive"),
            (finite(self.risk_free), "risk_free must be finite"),
        )
        for ok, message in rules:
            if not ok:
                raise ConfigError(message)

    @property
    def warmup(self) -> int:
        return max(self.hedge_window, self.zscore_window)

    @property
    def rate(self) -> float:
        """Interest per bar, compounding to the annual rate."""
        return (1 + self.risk_free) ** (1 / self.bars_per_year) - 1

    @property
    def accrual(self) -> float:
        return self.rate if self.cash_interest else 0.0

    @property
    def cost_rate(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 10_000

    def but(self, **changes) -> Config:
        return replace(self, **changes)

    def row(self, label: str) -> dict:
        return {"label": label, **asdict(self)}


PRICES = "date string, price_a double, price_b double"
BARS = "pair_id string, idx bigint, date date, price_a double, price_b double"
TRADES = (
    "pair_id string, direction string, entry_index bigint, exit_index bigint, entry_date date, exit_date date, "
    "entry_z double, exit_z double, pnl_gross double, costs double, pnl_net double, exit_reason string, holding_bars bigint"
)
