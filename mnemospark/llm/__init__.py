"""Operators for training-data work on text and vectors; nothing else in mnemospark imports this."""
