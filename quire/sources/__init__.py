"""Readers and writers of documents; Python is confined to the parsing and building of files."""
