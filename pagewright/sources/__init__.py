"""Readers for the engine's tables."""
