"""Spark operators for testing claims of the form "feature f encodes concept t"."""
