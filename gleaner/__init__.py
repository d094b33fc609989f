"""gleaner: query grounding, retrieval evaluation and log analytics as Spark DataFrame plans."""
