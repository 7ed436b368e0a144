"""Demand-gap feature engineering and forecasting on Spark DataFrames."""

from .config import DEFAULT, GridConfig

__all__ = ["DEFAULT", "GridConfig"]
