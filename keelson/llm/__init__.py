"""Operators of a large-scale training-data pipeline. Nothing else in the
library imports this subpackage; it may import the library's helpers."""
