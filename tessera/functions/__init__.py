"""functions of the copy-number engine."""
