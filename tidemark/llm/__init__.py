"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the queries are in
:mod:`tidemark.llm.queries`.
"""
