"""Column functions: value normalisers, shapes, names and phones."""
