"""Margins, discounts, horizons and grids with their defaults, passed to the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Assumptions:
    # Fixed values.
    seed: int = 20260214
    test_share: str = "0.30"
    contribution_margin: float = 0.65
    discount_rate_annual: float = 0.10
    horizon_months: int = 60
    offer_discount: float = 0.15
    offer_duration_months: int = 12
    offer_servicing_cost: float = 12.0
    targeting_deciles: int = 2
    assumed_save_rate: float = 0.25

    # The grids the economics are swept over.
    option_depths: tuple[int, ...] = (1, 2, 3, 4)
    option_offers: tuple[float, ...] = (0.10, 0.15, 0.20)
    swept_margins: tuple[float, ...] = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
    swept_offers: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20, 0.25)

    @property
    def monthly_discount_rate(self) -> float:
        return (1 + self.discount_rate_annual) ** (1 / 12) - 1


DEFAULTS = Assumptions()
# The dashboard starts from a smaller offer than the pipeline does.
DASHBOARD_DEFAULTS = Assumptions(offer_discount=0.10)
