"""Compositions of operators into whole jobs, and bindings of the given tables."""
