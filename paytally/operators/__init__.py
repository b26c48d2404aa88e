"""Checks, reconciliations and lookups over the three payment tables."""
