"""sources of the code-symbol engine."""
