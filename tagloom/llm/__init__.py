"""llm of tagloom."""
