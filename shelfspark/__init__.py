"""An analytics engine for retail sell-out data on Spark."""
