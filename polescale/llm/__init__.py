"""Corpus operators for training-data pipelines.

Nothing outside this package imports it; its queries live in
:mod:`polescale.llm.queries`.
"""
