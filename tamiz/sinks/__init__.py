"""Target tables, database appends and error reports."""
