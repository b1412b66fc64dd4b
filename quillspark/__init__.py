"""Document evidence and scoring analytics expressed as Spark DataFrame plans."""
