"""Flat records as they arrive."""
