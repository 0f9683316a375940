"""Whole jobs, and the registered queries with their oracle texts."""
