"""Queries over the library's operators, each with its SQL twin where SQL can say it."""
