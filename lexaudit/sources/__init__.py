"""Readers of documents, frameworks and catalogues."""
