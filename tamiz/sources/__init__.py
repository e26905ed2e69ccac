"""Scans: delimited text folders, workbooks, raw files, databases."""
