"""Spark-first analytics over raw text: parsing, extraction, provenance tables and bounded question answering."""
