"""Headway: public-transit analytics as plain Spark DataFrame jobs."""
