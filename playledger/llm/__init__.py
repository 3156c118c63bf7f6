"""Operators for training text: runs of repeated events, tokenizing, packing, repair of encodings."""
