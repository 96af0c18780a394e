"""Reversible transforms, codecs and statistics of bytes: numpy kernels and SQL forms."""
