"""quietday: gap-aware time-series features, forecasts and forecast verification on Spark."""
