"""Point-in-time analytics on Spark: bitemporal tables, series preparation, regimes, scores and audits."""
