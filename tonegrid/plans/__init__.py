"""Registered queries over tables, with their SQL."""
