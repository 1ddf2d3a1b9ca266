"""tapeworks: cross-sectional market-panel analytics as plain PySpark jobs."""
