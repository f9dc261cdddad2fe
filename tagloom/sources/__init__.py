"""sources of tagloom."""
