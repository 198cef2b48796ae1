"""A Spark-native relational analytics layer: operators, functions, sources and query plans."""
