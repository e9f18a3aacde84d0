"""Results as JSON, text reports and DOT graphs, written by Spark."""
