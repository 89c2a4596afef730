"""The registered queries: each names a plan over the driver's tables and its SQL equivalent."""

from __future__ import annotations

from textloom.plans import agreement, bibliography, concordance, files, frequency, keys, longtail, meaning, records, roundtrips, sketches, topicmodels

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _family in (frequency, keys, concordance, sketches, meaning, agreement, bibliography, topicmodels, longtail, files, records, roundtrips):
    QUERIES |= _family.QUERIES
    SQL |= _family.SQL
