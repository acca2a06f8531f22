"""Streaming forms of the sketches."""
