"""streaming of the copy-number engine."""
