"""Distributed operators; each module holds one family."""
