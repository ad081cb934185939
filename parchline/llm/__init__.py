"""Corpus operators over feature descriptions; nothing else in the library imports this package."""
