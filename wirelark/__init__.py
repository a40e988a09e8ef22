"""wirelark: Spark-native monitoring of incident news."""

__all__ = ["params", "session"]
