"""Operators and queries for preparing text corpora; nothing outside imports them."""
