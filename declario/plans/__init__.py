"""Models and mappings: declared on the driver, compiled to schemas and columns."""
