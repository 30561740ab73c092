"""Plot-level analytics and forecasting as DataFrame-in, DataFrame-out Spark operators."""
