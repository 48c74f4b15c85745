"""functions of answerlens."""
