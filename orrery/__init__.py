"""Structural-coordination analytics on Spark: graph, timing, entity resolution and scoring operators."""
