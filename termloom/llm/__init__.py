"""Training-data operators: language id, BPE, media, token counts, mixing,
license scans, substring dedup, LM scoring, Jaccard join, embedding dedup.

Nothing outside this subpackage imports it.
"""
