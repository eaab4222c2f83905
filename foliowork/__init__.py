"""foliowork: document conversion, scoring and corpus evaluation as Spark plans."""
