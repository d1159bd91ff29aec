"""DataFrame operators: access, documents, vector search, ranking, evidence, memory, sessions."""
