"""Connectivity-telemetry analytics on Spark."""
