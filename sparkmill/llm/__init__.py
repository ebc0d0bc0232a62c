"""Training-data operators. Nothing else in the package imports this subpackage."""
