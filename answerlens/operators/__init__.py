"""operators of answerlens."""
