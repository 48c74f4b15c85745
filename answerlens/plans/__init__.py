"""plans of answerlens."""
