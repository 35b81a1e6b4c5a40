"""Quillframe subpackage."""
