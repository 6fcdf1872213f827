"""DataFrame operators over mail tables."""
