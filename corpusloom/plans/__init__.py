"""Workflows composed from the operators."""
