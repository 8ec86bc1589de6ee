"""Table builds composed from the operators."""
