"""A PySpark-native engine for market-structure analytics and backtests."""

__version__ = "0.2.0"
