"""Positioning-telemetry and vector-tile analytics on PySpark."""
