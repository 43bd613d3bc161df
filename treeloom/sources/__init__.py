"""Readers and writers of genomic text formats. Compression is chosen by file extension, as Spark does."""
