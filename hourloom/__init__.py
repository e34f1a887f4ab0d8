"""hourloom: hourly sensor analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Timestamps are
``timestamp_ntz`` and the session time zone must be UTC; missing values are
NULL, never NaN.
"""
