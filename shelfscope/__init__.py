"""Retail-media analytics as DataFrame-to-DataFrame functions on Spark."""
