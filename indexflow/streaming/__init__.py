"""Live updates on Structured Streaming."""
