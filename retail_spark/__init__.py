"""Retail analytics, table maintenance and checkout processing as Spark jobs."""
