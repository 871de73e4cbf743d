"""Readers that turn files into documents, pages and words."""
