"""logloom: Spark-native analytics over conversation and agent-session logs."""
