"""Tidemark: a PySpark engine for analysing revisions of documents."""
