"""A Spark-native engine for typed property graphs: schemas, pattern queries, search, loading, snapshots."""
