"""Training-data operators: quality, fingerprints, decontamination, mixing, joins, secrets, scoring, output.

Self-contained: nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
