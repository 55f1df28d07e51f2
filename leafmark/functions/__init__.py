"""See the package docstring of leafmark."""
