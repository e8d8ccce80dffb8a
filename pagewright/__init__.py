"""A PySpark-native engine for analysing web documents: URLs, blocks, text, keyed state and Markdown."""

__version__ = "0.1.0"
