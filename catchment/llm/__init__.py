"""Preparation of training data at scale; nothing outside this package imports it."""
