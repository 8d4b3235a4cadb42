"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from larkfield.plans import cases, corpora, retrieval, tables

QUERIES: dict = {**retrieval.QUERIES, **corpora.QUERIES, **cases.QUERIES, **tables.QUERIES}
SQL: dict = {**retrieval.SQL, **corpora.SQL, **cases.SQL, **tables.SQL}
