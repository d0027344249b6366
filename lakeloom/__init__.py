"""Fact, rule and catalog analytics on Spark."""
