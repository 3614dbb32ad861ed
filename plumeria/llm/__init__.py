"""Training-data operators: toxicity, repeated passages, near duplicates, archives, media, tokens and mixing.

Nothing else in the library imports this subpackage.
"""
