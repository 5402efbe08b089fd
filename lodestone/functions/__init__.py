"""Column functions and driver-side parsers."""
