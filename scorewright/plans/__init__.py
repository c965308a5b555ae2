"""Registered queries, each with its SQL twin where SQL can say it."""
