"""A PySpark-native code-graph analytics engine; facts are DataFrames, queries are plans."""
