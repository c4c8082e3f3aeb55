"""lexweave: text entity-linking analytics expressed as lazy Spark DataFrame plans."""
