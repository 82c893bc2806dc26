"""Graph operators over edge and node tables."""
