"""Clause libraries on Spark: structuring, retrieval, rule review and corpus work as DataFrame jobs."""
