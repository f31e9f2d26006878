"""quillmesh: a PySpark engine for document corpora (catalog, retrieval, change detection, claims, data quality)."""
