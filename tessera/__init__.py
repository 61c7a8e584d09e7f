"""Tessera: a semantic-memory analytics engine expressed as Spark DataFrame jobs."""
