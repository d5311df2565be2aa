"""Section retrieval and text analytics over document corpora, as PySpark plans."""
