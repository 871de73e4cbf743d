"""Span detectors, propagation, overlap resolution, findings, review and redaction."""
