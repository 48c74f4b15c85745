"""sources of answerlens."""
