"""Operators for preparing large text corpora: documents in, decisions and digests out."""
