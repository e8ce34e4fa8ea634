"""panelspark: failure prediction on daily device telemetry, written for Spark.

Every operator takes and returns a Spark ``DataFrame`` and is built from column expressions, joins,
aggregates and windows.
"""
