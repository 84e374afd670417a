"""Policy-driven data masking and audit analytics on Spark."""
