"""Operators of a large-scale training-data pipeline (see README, "llm").

Nothing outside this subpackage imports it; ``queries.py`` lists its registered queries and oracle SQL.
"""
