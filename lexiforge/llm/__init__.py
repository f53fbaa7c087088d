"""Training-data operators (dedup, quality, privacy, sharding, tokenizers, media).

Nothing outside this subpackage imports it: deleting the folder leaves the rest
of the library working.
"""
