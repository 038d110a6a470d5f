"""Text chunking, BM25 and hybrid retrieval as DataFrame operations."""
