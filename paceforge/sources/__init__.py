"""Readers, writers and the model registry."""
