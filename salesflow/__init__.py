"""Retail-sales cleaning, profiling and analytics as Spark DataFrame operators."""
