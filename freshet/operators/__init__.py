"""Operators over definitions, the dependency graph, tables and the run log."""
