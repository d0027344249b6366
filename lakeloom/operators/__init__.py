"""Operators over facts, catalog entries and observations."""
