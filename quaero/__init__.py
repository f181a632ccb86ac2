"""quaero: ranked-retrieval analytics expressed as PySpark plans."""
