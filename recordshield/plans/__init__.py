"""Operators put together for a whole table."""
