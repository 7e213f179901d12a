"""A PySpark engine for measuring graph repair and document-derived facts."""
