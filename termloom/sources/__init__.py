"""Readers of terminology files, pair sources and corpora, and table sinks."""
