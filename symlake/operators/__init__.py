"""operators of the code-symbol engine."""
