"""Text and code retrieval analytics expressed as Spark DataFrame plans."""
