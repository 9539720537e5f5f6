"""All core queries and their SQL."""

from __future__ import annotations

from headway.plans import feed_quality, transit

FLAGSHIP = "connections"
QUERIES = transit.QUERIES | feed_quality.QUERIES
SQL = transit.SQL | feed_quality.SQL
