"""Registered queries: what ``__spark_entry__`` offers, each with its SQL where SQL can express it."""
