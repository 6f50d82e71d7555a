"""Column functions for normalising, splitting and pronouncing text."""
