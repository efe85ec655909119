"""Checks and health measures for corpora of semi-structured documents, as Spark plans."""
