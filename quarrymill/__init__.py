"""quarrymill: retrieval, evaluation and corpus statistics as Spark plans."""
