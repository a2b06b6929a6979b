"""Images in and out of pixel tables."""
