"""streaming of answerlens."""
