"""Messy delimited files to typed tables, and SQL answers to scores, as Spark jobs."""
