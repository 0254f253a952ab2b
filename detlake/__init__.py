"""Detection-evaluation analytics as Spark plans."""
