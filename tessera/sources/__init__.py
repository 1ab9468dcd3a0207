"""Readers: files of many formats, captions, web pages, connectors."""
