"""Signal operators. Importing the package fills the registry."""

from . import arithmetic, crosssection, timeseries
from .registry import ASSET, DATE, OPERATORS, ROW, Operator

__all__ = ["ASSET", "DATE", "OPERATORS", "ROW", "Operator", "arithmetic", "crosssection", "timeseries"]
