"""sources of the copy-number engine."""
