"""The adapter registry (U01): one normaliser per source key.

``normalise(source, landed)`` turns the landed payloads of one source into
results.  A source that reads two kinds of response has one entry per kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vigil.conventions import AS_OF
from vigil.sources import feeds, html_jobs, json_api

NORMALISERS: dict[str, Callable[..., DataFrame]] = {
    **json_api.NORMALISERS, **feeds.NORMALISERS,
    "playbill_jobs": html_jobs.normalise_playbill,
    "usitt_jobs": html_jobs.normalise_usitt,
    "medrxiv": json_api.normalise_biorxiv,  # same response, other server
}

#: Source keys that a topic may name.
ADAPTERS = {"tmdb" if k.startswith("tmdb_") else k for k in NORMALISERS}


def normalise(source: str, landed: DataFrame, as_of=AS_OF) -> DataFrame:
    return NORMALISERS[source](landed, as_of)
