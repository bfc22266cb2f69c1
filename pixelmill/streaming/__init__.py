"""The watched folder and keyed state under Structured Streaming."""
