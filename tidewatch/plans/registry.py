"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from tidewatch.plans import chat, checks, compare, consumed, feeds, more, panels, rules, streams  # noqa: F401
from tidewatch.plans.common import ORACLE_SQL, QUERIES  # noqa: F401
