"""The same rules on Structured Streaming sources."""
