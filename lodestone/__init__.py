"""lodestone: evidence retrieval, evaluation and relational analytics as Spark DataFrame plans."""
