"""Query objects and conversion plans."""
