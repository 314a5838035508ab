"""From source text to fact rows."""
