"""Folder watch with Structured Streaming."""
