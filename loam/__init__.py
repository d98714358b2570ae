"""loam: corpus, retrieval and usage analytics expressed as Spark DataFrame plans."""
