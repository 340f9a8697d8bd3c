"""Count surveillance on Spark: panels, rolling-origin forecasts, scores and early-warning alerts."""

__version__ = "0.1.0"
