"""factweave: program-fact and corpus analytics expressed as Spark DataFrame plans."""
