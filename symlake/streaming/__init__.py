"""streaming of the code-symbol engine."""
