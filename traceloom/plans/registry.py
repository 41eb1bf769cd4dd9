"""All queries of the core, and their SQL."""

from __future__ import annotations

from traceloom.plans import images, problems, traces

QUERIES = {**problems.QUERIES, **traces.QUERIES, **images.QUERIES}
SQL = {**problems.SQL, **traces.SQL, **images.SQL}
