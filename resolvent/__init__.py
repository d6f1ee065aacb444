"""Name resolution and eligibility analytics on Spark."""
