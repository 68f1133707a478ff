"""Readers, writers and the working tables that cut lineage."""
