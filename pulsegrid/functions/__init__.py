"""Column functions: no DataFrame in, no DataFrame out."""
