"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage; its queries are added by
``__spark_entry__`` when it can be imported.
"""
