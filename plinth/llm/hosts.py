"""Hosts of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, optional user, host; the host ends at a port, path, query or fragment.
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)"


def host_of(url: Column) -> Column:
    """The lower-case host without a final dot; null where there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(found != "", found)
