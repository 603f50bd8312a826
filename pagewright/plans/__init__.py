"""Registered queries and session helpers."""
