"""Training-data operators: PII, deduplication, packing, decontamination, toxicity, WARC, sharding, language ID.

Nothing outside this package imports it.
"""
