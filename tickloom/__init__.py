"""Market-tick analytics on Spark: parse, throttle, spread, store, roll up, query."""
