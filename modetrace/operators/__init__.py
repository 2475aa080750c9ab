"""Operators on GPS points, trips and segments."""
