"""The store's log followed by Structured Streaming."""
