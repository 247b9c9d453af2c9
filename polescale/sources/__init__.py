"""Readers and writers of corpora, lexicons, predictions and reports."""
