"""siftwell: text retrieval measurement and corpus operators as Spark plans."""
