"""Corpus operators for large text collections; nothing else in the library imports this subpackage."""
