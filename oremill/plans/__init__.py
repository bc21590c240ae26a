"""plans of oremill."""
