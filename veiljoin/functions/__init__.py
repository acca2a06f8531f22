"""Seeded draws and the privacy budget."""
