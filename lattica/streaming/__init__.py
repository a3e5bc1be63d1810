"""Streaming analysis: the decoder is stateless by row, so it runs unchanged on streams."""
