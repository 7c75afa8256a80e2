"""Column helpers with the panel's missing-value rules."""

from .scalar import bounded, finite, ieee_div, mean_rank, nan_to_null, pearson, safe_ln

__all__ = ["bounded", "finite", "ieee_div", "mean_rank", "nan_to_null", "pearson", "safe_ln"]
