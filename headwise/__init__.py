"""headwise: scheduled-service operations analytics as lazy Spark DataFrame operators."""

from headwise.settings import DEFAULTS, Thresholds

__all__ = ["DEFAULTS", "Thresholds"]
