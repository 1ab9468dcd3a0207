"""DataFrame operators: chunks, search, access, conversations, evidence, graph."""
