"""Operators over pages, blocks, items and documents."""
