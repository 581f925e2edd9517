"""Reading and writing messages and vector tables."""
