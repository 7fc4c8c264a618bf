"""driftlens: Spark-native analytics over versioned library interfaces."""

__version__ = "0.1.0"
