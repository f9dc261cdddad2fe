"""functions of tagloom."""
