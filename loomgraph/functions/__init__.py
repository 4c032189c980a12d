"""functions of the code graph."""
