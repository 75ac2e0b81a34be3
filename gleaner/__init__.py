"""Passage retrieval, retrieval evaluation and corpus preparation as Spark jobs."""
