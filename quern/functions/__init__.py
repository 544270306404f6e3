"""Column builders. All but the two functions of unicode.py are built-in expressions."""
