"""rillcount: weighted stream summaries as Spark DataFrames.

Heavy hitters, item counts, range sums, quantiles, second moments and join
sizes over large tables and streams, with exact answers beside them to measure
how good the summaries are.
"""
