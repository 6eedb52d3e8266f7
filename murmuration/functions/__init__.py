"""Column builders: keyed random numbers and densities."""
