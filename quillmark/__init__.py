"""Quillmark: Markdown parsing, rendering and analysis as Spark columns and relations."""
