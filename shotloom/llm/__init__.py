"""Operators for preparing language-model training corpora at scale.

Nothing outside this subpackage imports it; its queries and SQL are in ``llm.queries``.
"""
