"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

from siftline.plans import addresses, alerting, content, editing, records, results, rules, saving, service, tables  # noqa: F401  they register their queries
from siftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
