"""lexmill: a Spark-native corpus ledger and analytics engine."""
