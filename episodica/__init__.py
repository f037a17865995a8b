"""Commissioning analytics over episodic, multi-signal time series, as Spark DataFrame operators."""
