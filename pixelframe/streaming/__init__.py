"""Image folders as streams."""
