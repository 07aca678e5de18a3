"""Spark jobs for page-text cleaning, narration preparation and tabular work."""
