"""Byte-exact token-stream analytics on Spark."""
