"""Measurements, policy, comparison and evidence operators on signals and findings."""
