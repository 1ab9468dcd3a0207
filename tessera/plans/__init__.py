"""Registered queries over the standard tables, each with SQL that another engine can run."""

from tessera.plans import answers, citations, conversations, corpus, documents, files, graph, ingestion, memory, prompts, relational, speech, streams, tools
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "citations", "conversations", "corpus", "documents", "files", "graph", "ingestion", "memory", "prompts", "relational", "speech", "streams", "tools"]
