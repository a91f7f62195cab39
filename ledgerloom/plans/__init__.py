"""Composed flows, the query registry and its SQL."""
