"""sparkcast: preparing, forecasting and evaluating many keyed time series as Spark jobs."""
