"""Jobs that chain operators, and the catalog of queries over the driver tables."""
