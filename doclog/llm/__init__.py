"""Operators for preparing training data at scale. Nothing outside this folder, its tests and corpus_pipeline.py needs it."""
