"""Column functions on pixels; all stay inside code generation."""
