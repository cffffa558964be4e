"""The parser and renderers for one document, in plain Python and without Spark."""
