"""plans of the copy-number engine."""
