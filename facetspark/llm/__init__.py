"""Operators of a training-data pipeline. Nothing outside this subpackage (and the
repository's ``corpus_pipeline.py``) imports it."""
