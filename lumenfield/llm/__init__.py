"""Operators for preparing training text; ``QUERIES`` and ``ORACLES`` hold their registered queries.

Nothing outside this package imports it.
"""

from lumenfield.llm.registry import ORACLES, QUERIES  # noqa: F401
