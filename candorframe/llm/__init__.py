"""Operators of a training-data pipeline: archives, packing, secret scans, mixing, quality, language models, near copies, links, search."""
