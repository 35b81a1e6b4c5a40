"""Quillframe: document and frame analytics expressed as Spark DataFrame transformations."""
