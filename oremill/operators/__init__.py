"""operators of oremill."""
