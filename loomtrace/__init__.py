"""Spark-native analytics over append-only agent event logs, their messages and their documents."""
