"""Operators for building text corpora: filtering, deduplication, decontamination, tokenizing and extraction."""
