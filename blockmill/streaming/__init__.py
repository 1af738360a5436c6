"""Tables that grow by files, read by Structured Streaming."""
