"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries
and ``oracles.py`` the SQL that checks them.
"""
