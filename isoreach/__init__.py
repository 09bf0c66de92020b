"""isoreach: spatial accessibility analytics expressed as Spark DataFrame plans."""
