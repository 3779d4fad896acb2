"""Hexapla: batch hybrid retrieval, citation algebra and provenance for text corpora, as Spark plans."""
