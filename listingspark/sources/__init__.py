"""Landed feeds and pages in, versioned tables out."""
