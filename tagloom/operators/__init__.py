"""operators of tagloom."""
