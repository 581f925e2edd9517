"""Operators of a pipeline that prepares training text. Nothing else in the library imports this subpackage."""
