"""Inputs derived from the benchmark tables, and the registered queries."""
