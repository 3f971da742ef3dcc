"""A Spark-first engine for document ingestion, retrieval and conversation analytics."""
