"""Structured Streaming jobs over the two append-only inputs: stored replies and trial logs."""
