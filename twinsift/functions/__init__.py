"""Column builders: properties, scalar functions and filter expressions."""
