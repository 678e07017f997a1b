"""A PySpark engine for code-knowledge and text corpora."""
