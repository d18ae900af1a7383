"""Training-data operators: deduplication, decontamination, classifiers, tokenizers, vector search.

Nothing outside this folder imports it.
"""
