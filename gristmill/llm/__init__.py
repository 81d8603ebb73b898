"""Operators for preparing training data.

Nothing outside this subpackage imports it; deleting it leaves the rest of the
library whole.  Queries are registered by :mod:`gristmill.llm.catalog`.
"""
