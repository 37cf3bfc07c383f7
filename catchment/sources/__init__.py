"""Typed readers, writers and the frame cache."""
