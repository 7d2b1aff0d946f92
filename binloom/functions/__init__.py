"""binloom."""
