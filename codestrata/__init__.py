"""Part of codestrata, a Spark engine for code-structure analytics."""
