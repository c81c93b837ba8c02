"""DataFrame operators of the dosimetry library."""
