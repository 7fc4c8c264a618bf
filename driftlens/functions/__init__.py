"""Column functions: scalars over names and versions, and the change taxonomy."""
