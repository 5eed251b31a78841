"""Audit, cleaning, splitting and evaluation of labelled tables on Spark."""
