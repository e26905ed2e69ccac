"""Column -> Column helpers; all of them are built-in expressions."""
