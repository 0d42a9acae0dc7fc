"""Operators of a large-scale training-data pipeline (texts, chats, pages); nothing else in the library imports this."""
