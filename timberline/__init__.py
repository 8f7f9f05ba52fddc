"""Certified tree analytics and corpus preparation on Spark."""
