"""All queries of the reference's operators, with their SQL."""

from __future__ import annotations

from termweave.plans import evaluation, inout, retrieval, standard, vocabulary, whole  # noqa: F401  they register themselves
from termweave.plans.tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
