"""A Spark-native engine for knowledge graphs: build, navigate, search, audit and grade."""
