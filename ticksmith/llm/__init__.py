"""Training-data operators: tokens, chat, HTML, packing, toxicity, WARC, near-duplicates, FLAC and decontamination.

Nothing else in the library imports this subpackage.
"""
