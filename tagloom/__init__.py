"""Tag analytics on Spark: extract, count, build daily panels, score forecasts.

Every public function maps DataFrames or Columns to DataFrames or Columns.  No
session is created here; parameters that a run may want to change are keyword
arguments with the usual values as defaults.
"""
