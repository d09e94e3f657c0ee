"""Operators on corpora for language models: text forms, packing, mixing.  Nothing outside this folder imports it."""
