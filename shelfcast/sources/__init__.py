"""Readers, writers and the mapping of warehouse tables to retail tables."""
