"""Relational, ordered, graph and per-series operators."""
