"""streaming of tagloom."""
