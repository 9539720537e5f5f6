"""Client of the public catalogue of feeds; used on the driver only, and only when asked."""

from __future__ import annotations

import getpass
import json
import os
import re
import urllib.parse
import urllib.request

API = "https://api.mobilitydatabase.org/v1"


def request_json(url: str, token: str | None = None, body: dict | None = None) -> object:
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}) | ({"Content-Type": "application/json"} if body else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode() if body else None, headers)) as answer:  # noqa: S310
        return json.load(answer)


def access_token(environment: dict | None = None, ask=getpass.getpass) -> str:
    """From the environment, else by exchanging a refresh token from there or from a hidden prompt."""
    env = os.environ if environment is None else environment
    if env.get("MOBILITY_DATABASE_ACCESS_TOKEN"):
        return env["MOBILITY_DATABASE_ACCESS_TOKEN"]
    refresh = env.get("MOBILITY_DATABASE_REFRESH_TOKEN") or ask("Refresh token: ")
    return request_json(f"{API}/tokens", body={"refresh_token": refresh})["access_token"]


def search(query: str, token: str, get=request_json) -> list[dict]:
    """A feed by its id, or at most 25 schedule feeds that match a text. Finding none, or a feed of another kind, is an error."""
    if re.fullmatch(r"mdb-\d+", query):
        found = [get(f"{API}/gtfs_feeds/{query}", token)]
    else:
        answer = get(f"{API}/search?{urllib.parse.urlencode({'search_query': query, 'data_type': 'gtfs', 'limit': 25})}", token)
        found = answer.get("results", [])
    feeds = [f for f in found if f.get("data_type", "gtfs") == "gtfs"]
    if not feeds:
        raise ValueError(f"The catalogue has no schedule feed for {query}")
    return feeds


def feed_url(feed: dict, custom: str | None = None) -> str:
    """A given URL, else the publisher's if it needs no key, else the hosted copy."""
    if custom:
        return custom
    source = feed.get("source_info") or {}
    if source.get("producer_url") and not source.get("authentication_type"):
        return source["producer_url"]
    hosted = (feed.get("latest_dataset") or {}).get("hosted_url")
    if not hosted:
        raise ValueError(f"No address known for {feed.get('id')}")
    return hosted
