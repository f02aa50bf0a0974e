"""Spark-native strategy validation: panels, rolling and as-of operators, backtests, inference gates."""
