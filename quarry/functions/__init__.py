"""See the package docstring of ``quarry``."""
