"""The encoding, scoring and metric logic on Structured Streaming."""
