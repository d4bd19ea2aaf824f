"""assay: measure how far code changes, their oracles and text corpora can be trusted, as Spark DataFrame operators."""
