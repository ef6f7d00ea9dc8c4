"""Training-data operators: packing, near-duplicate and line removal, token files,
personal data, quality, substring removal, toxicity, language and decontamination.

Nothing outside this package imports it.
"""
