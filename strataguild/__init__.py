"""Grouped distribution analytics on PySpark.

Every operator takes and returns DataFrames.  Work that touches rows stays in
Spark expressions; rows are never gathered per group, so one group may hold any
share of the data.
"""
