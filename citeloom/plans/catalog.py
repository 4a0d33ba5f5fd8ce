"""All queries of the library outside the llm subpackage, by name."""

from __future__ import annotations

from citeloom.plans import details, pipelines, reference  # noqa: F401  (details adds to reference.QUERIES)

flagship = reference.flagship
QUERIES = {**reference.QUERIES, **pipelines.QUERIES}
SQL = {**reference.SQL, **pipelines.SQL}
