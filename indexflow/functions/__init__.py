"""Built-in functions, user functions and value codecs."""
