"""Handoff analytics on Spark."""
