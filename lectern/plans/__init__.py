"""Registered plans over the shared tables."""
