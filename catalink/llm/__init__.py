"""Operators for cleaning and mixing training text; nothing outside this package imports them."""
