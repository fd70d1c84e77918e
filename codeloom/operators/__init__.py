"""Graph operators over request tables."""
