"""Tarnwork: evidence-audit analytics expressed as Spark DataFrame plans."""
