"""Compositions of operators and the registry of named queries."""
