"""tablewright: contract-driven tables on Spark."""
