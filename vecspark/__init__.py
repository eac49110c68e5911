"""vecspark: vector and hybrid retrieval analytics as Spark plans."""
