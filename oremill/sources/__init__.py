"""sources of oremill."""
