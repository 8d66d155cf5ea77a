"""tidegauge: data-quality checks and alert-stream analytics on Spark DataFrames.

Every operator takes DataFrames plus a small policy and returns a lazy
DataFrame, so operators chain with ``df.transform``.
"""
