"""Text to tables: parsers that regular expressions can't express."""
