"""Settings of a service: a file of KEY=value lines under the environment, with typed readings of some."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

POLL_SECONDS = 20


def parse(lines: list[str]) -> dict[str, str]:
    """Values of KEY=value lines; blank lines, comments and lines without a sign are skipped, quotes around a value go."""
    out: dict[str, str] = {}
    for line in map(str.strip, lines):
        key, sign, value = line.partition("=")
        if sign and not line.startswith("#"):
            out[key.strip()] = value.strip().strip('"').strip("'")
    return out


def settings(lines: list[str], environment: Mapping[str, str], required: tuple[str, ...] = ()) -> dict[str, str]:
    """The file's values with the environment's over them, trimmed; empty ones are left out, missing required ones an error."""
    both = {**parse(lines), **environment}
    out = {k: v.strip() for k, v in both.items() if v.strip()}
    missing = [k for k in required if k not in out]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out


def ids(raw: str) -> list[int]:
    """A comma-separated list of ids."""
    return [int(x) for x in raw.split(",") if x.strip()]


def id_list(raw: Column) -> Column:
    """The same as an expression."""
    return F.transform(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("long"))


def poll_seconds(raw: str | None) -> int:
    """Seconds to wait for updates, one at least; anything unreadable is the default."""
    try:
        return max(1, int(raw)) if raw is not None else POLL_SECONDS
    except ValueError:
        return POLL_SECONDS


def download_headers(agent: str, token: str | None = None) -> dict[str, str]:
    """Headers of a download, with its authorisation if there is a token."""
    return {"User-Agent": agent, "Accept": "application/octet-stream"} | ({"Authorization": f"Bearer {token}"} if token else {})


def local_version(now: datetime) -> str:
    """The version of a registry that was built here."""
    return now.strftime("local-%Y%m%d%H%M%S")
