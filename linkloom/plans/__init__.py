"""Whole jobs made of operators, and their queries."""
