"""Readers, writers and the demand view over an order book."""
