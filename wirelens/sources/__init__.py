"""Readers and writers: captures, catalogues, interface documents, outputs."""
