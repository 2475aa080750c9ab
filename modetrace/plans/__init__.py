"""Whole plans: the queries, their SQL and the batch pipeline."""
