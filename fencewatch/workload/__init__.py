"""Landed-page tables and queries over the test tables."""
