"""Change data capture and streaming."""
