"""Operators on the text of large language model corpora; nothing else in the library imports this."""
