"""DataFrame operators over the edge and vertex tables."""
