"""Operators that prepare training text: scoring, filtering, matching, tokenizing, formatting.

Nothing outside this folder imports it; its queries are in ``queries.py``.
"""
