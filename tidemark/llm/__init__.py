"""Training-data operators: text quality, privacy, deduplication, sharding and tokenisation on Spark.

Nothing outside this subpackage imports it.  Shared rules: null text counts as empty, extra
columns of the input are ignored by the operators (each selects what it reads), and rows are
never capped or sampled unless a parameter of a fitted classifier says so.
"""
