"""Chronologically tested models on MLlib."""
