"""Whole runs that chain the operators."""
