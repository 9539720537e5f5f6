"""Mixed times and dates one value at a time, with Python's own calendar and zones."""

import re
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

OFFSETS = {"UTC": 0, "GMT": 0, "Z": 0, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "IST": 5.5, "JST": 9, "EST": -5, "EDT": -4, "MST": -7, "MDT": -6}
STAMPS = ("%Y-%m-%d", "%Y/%m/%d", "%d %b %Y", "%d-%b-%Y", "%b %d, %Y", "%A %d %B %Y", "%Y%m%d", "%Y-%j")
CLOCKS = ("", " %H:%M:%S", "T%H:%M:%S", " %H:%M", "T%H:%M", "T%H%M%S", "%H%M%S")


def day_orders(order):
    d = "%d{0}%m{0}" if order == "DMY" else "%m{0}%d{0}"
    return [(d + y).format(sep) for y in ("%Y", "%y") for sep in "./-"]


def wall(text, order, timed):
    """(datetime, has a time) of a local date or date and time, or None."""
    text = re.sub(r"(:\d\d)[.,]\d+$", r"\1", text)
    for f in [*day_orders(order), *STAMPS]:
        for c in CLOCKS:
            if timed and not c or "%H%M%S" in c and f != "%Y%m%d":
                continue
            try:
                return datetime.strptime(text, f + c), bool(c)
            except ValueError:
                pass
    return None


def utc_of(local, zone):
    """UTC of a wall clock, `ambiguous` or `nonexistent`."""
    found = set()
    for fold in (0, 1):
        u = local.replace(tzinfo=zone, fold=fold).astimezone(UTC)
        if u.astimezone(zone).replace(tzinfo=None) == local:
            found.add(u)
    return "nonexistent" if not found else "ambiguous" if len(found) > 1 else found.pop()


def instant(text, zone, order, timed):
    """A datetime in UTC, a local datetime (no zone, date only), a word, or None."""
    if re.fullmatch(r"\d{9,10}|\d{12,13}", text):
        return datetime.fromtimestamp(int(text) // (1000 if len(text) > 11 else 1), UTC)
    for pattern, kind in ((r"(.*?\d)\s*\[?([A-Za-z]+/[A-Za-z_]+)\]?", "named"), (r"(.*[T ]\d.*?\d)\s*([+-]\d\d(?::?\d\d)?)", "offset"), (r"(.*\d)\s*(Z|[A-Z]{2,4})", "short")):
        m = re.fullmatch(pattern, text)
        w = m and wall(m[1], order, True)
        if not w:
            continue
        if kind == "named":
            return utc_of(w[0], ZoneInfo(m[2]))
        if kind == "short":
            return (w[0] - timedelta(hours=OFFSETS[m[2]])).replace(tzinfo=UTC)
        digits = re.sub(r"\D", "", m[2]).ljust(4, "0")
        shift = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        return (w[0] - (shift if m[2][0] == "+" else -shift)).replace(tzinfo=UTC)
    w = wall(text, order, timed)
    if not w:
        return None
    return utc_of(w[0], zone) if timed else w[0]


def time_value(value, service_date, zone, order):
    """norm_value of a time, or None if it states none."""
    text = (value or "").strip(" \t")
    m = re.fullmatch(r"(\d{1,3})[:.hH](\d\d)(?:[:.m](\d\d)(?:[.,]\d+|s)?)?\s*([apAP]\.?[mM]\.?)?", text) or re.fullmatch(r"(\d\d)(\d\d)(\d\d)()", text)
    if m:
        h, mi, s = int(m[1]), int(m[2]), int(m[3] or 0)
        if mi > 59 or s > 59:
            return None
        if m[4]:
            h = h % 12 + (12 if m[4][0] in "pP" else 0)
        local = datetime.strptime(service_date, "%Y%m%d").replace(tzinfo=zone)
        u = local.astimezone(UTC) + timedelta(hours=h, minutes=mi, seconds=s)
    else:
        u = instant(text, zone, order, True)
    return u if u is None or isinstance(u, str) else u.strftime("%Y-%m-%dT%H:%M:%SZ")


def date_value(value, zone, order):
    u = instant((value or "").strip(" \t"), zone, order, False)
    if u is None or isinstance(u, str):
        return u
    return (u.astimezone(zone) if u.tzinfo else u).date().isoformat()


assert date
