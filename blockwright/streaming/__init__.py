"""Encoding and decoding of streams."""
