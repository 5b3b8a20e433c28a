"""Cohort incident analytics as Spark jobs: quality gates, profiling, metrics, detection, attribution, decisions."""
