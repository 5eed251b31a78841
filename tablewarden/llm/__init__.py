"""Operators for preparing text corpora: deduplication, mixing, tokenising, scoring, archives, search, scans."""
