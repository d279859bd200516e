"""Location clustering and route analytics as Spark jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming", "session"]
