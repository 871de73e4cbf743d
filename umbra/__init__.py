"""A PySpark engine for finding, resolving and redacting personal data in documents."""
