"""Registered queries over the standard tables, by subject, each with its SQL."""
