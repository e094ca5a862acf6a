"""Oriel: RDF and ontology quality, and corpus preparation, as Spark DataFrame plans."""
