"""Operators for training-data corpora. Nothing else in framesift imports this."""
