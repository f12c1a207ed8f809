"""A retrieval and data-processing engine for source code and documents on PySpark."""
