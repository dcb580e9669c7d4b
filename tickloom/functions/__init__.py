"""Column and projection helpers; all of them compile to built-in expressions."""
