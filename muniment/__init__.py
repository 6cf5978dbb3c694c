"""muniment: prosopography analytics expressed as Spark DataFrame and SQL operators."""
