"""Running statistics over arriving files."""
