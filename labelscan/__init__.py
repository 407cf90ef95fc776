"""Label-text analytics as DataFrame operators for Spark."""
