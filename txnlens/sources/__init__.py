"""Readers, writers and the transaction views."""
