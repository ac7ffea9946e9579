"""Registered queries of the core; each module has QUERIES and, where SQL can say the same, SQL."""

CORE = ["parsing", "text_queries", "graph_queries", "provenance_queries", "answer_queries", "retrieval_queries"]
