"""Operators of a training-data pipeline: tokenising, near copies, archives, quality, search, chat, mixing, secrets."""
