"""functions of the code-symbol engine."""
