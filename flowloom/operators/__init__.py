"""Operators over transfers, half-edges, groups and clusters."""
