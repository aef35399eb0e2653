"""Dates, durations and names as people write them; for parameters, on the driver."""

import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

DAY = 86400
#: Days of the units of relative dates.
UNIT_DAYS = {"d": 1, "w": 7, "m": 30.44, "y": 365.25}


def parse_date(value: str, now: float | None = None) -> int:
    """Epoch seconds of a year, month, day, ISO time, epoch seconds or milliseconds, or a time before now like 30d or 2y."""
    s = value.strip()
    if re.fullmatch(r"\d{9,10}|\d{13}", s):
        return int(s[:10] if len(s) == 13 else s)
    if m := re.fullmatch(r"(?i)(\d+)\s*(?:(d)(?:ays?)?|(w)(?:eeks?)?|(m)(?:o|onths?)?|(y)(?:r|ears?)?)", s):
        unit = next(u for u in m.groups()[1:] if u).lower()
        return int((time.time() if now is None else now) - int(m[1]) * UNIT_DAYS[unit] * DAY)
    try:
        if re.fullmatch(r"\d{4}", s):
            s += "-01"
        if re.fullmatch(r"\d{4}-\d{2}", s):
            s += "-01"
        if not re.match(r"\d{4}-\d{2}-\d{2}", s):
            raise ValueError
        at = datetime.fromisoformat(s.upper())
    except ValueError:
        raise ValueError(f"{value!r} is not a date") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def day(created: Column) -> Column:
    return F.date_format(F.timestamp_seconds(created), "yyyy-MM-dd")


def duration(seconds: float) -> str:
    minutes, s = divmod(int(seconds), 60)
    hours, m = divmod(minutes, 60)
    return f"{hours}h{m:02d}m" if hours else f"{m}m{s:02d}s"


def subreddit_names(values: list[str]) -> list[str]:
    """Names out of lists of names with commas or blanks and maybe r/ in front; one of each, without case, as first spelled."""
    found: dict[str, str] = {}
    for word in re.split(r"[,\s]+", " ".join(values)):
        name = re.sub(r"(?i)^/?r/", "", word)
        if name and not re.fullmatch(r"\w{2,21}", name, re.ASCII):
            raise ValueError(f"{name!r} is not a subreddit name")
        if name:
            found.setdefault(name.lower(), name)
    return list(found.values())
