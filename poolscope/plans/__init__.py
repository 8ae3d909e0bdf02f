"""The fourteen reports, each one function from input tables to a result."""

from .lending import (
    borrow_deposit_ratios,
    market_leaders,
    off_peg_hours,
    reserve_revenue,
    volatility_and_apy,
    whale_interactions,
)
from .pools import (
    central_band_by_pool,
    range_response_by_class,
    range_response_shares,
    top_pools_by_class,
)
from .providers import cohort_balances, fees_by_provider, largest_providers, new_providers

__all__ = [
    "borrow_deposit_ratios",
    "central_band_by_pool",
    "cohort_balances",
    "fees_by_provider",
    "largest_providers",
    "market_leaders",
    "new_providers",
    "off_peg_hours",
    "range_response_by_class",
    "range_response_shares",
    "reserve_revenue",
    "top_pools_by_class",
    "volatility_and_apy",
    "whale_interactions",
]
