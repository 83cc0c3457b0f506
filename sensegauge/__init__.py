"""Evaluation of meaning preservation between sentence pairs, as Spark plans."""
