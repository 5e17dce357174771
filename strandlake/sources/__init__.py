"""Readers and writers of sequence files; all go through Spark's own sources, so any store it reads will do."""
