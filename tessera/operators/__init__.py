"""operators of the copy-number engine."""
