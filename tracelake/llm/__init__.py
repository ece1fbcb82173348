"""Operators for building large training corpora; nothing else in the library imports this subpackage."""
