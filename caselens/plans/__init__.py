"""Compositions of operators, registered as queries over the driver tables with their SQL equivalents."""
