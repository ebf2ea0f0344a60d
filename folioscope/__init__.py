"""Document-corpus analytics and ranked retrieval as Spark DataFrame operators."""
