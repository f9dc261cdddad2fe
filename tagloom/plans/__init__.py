"""plans of tagloom."""
