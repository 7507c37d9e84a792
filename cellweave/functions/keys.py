"""Keys of the panel: weeks, fixed-grid cells, periods, bands and labels as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = r"^g([0-9.]+)_r(-?[0-9]+)_c(-?[0-9]+)$"


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week (session time zone UTC)."""
    return F.date_trunc("week", ts)


def period_key(ts: Column, by: str = "week") -> Column:
    """``2024-W05`` or ``2024-01``: the ISO week with its own year, or the month."""
    if by == "month":
        return F.date_format(ts, "yyyy-MM")
    thursday = F.date_add(F.date_trunc("week", ts).cast("date"), 3)
    return F.format_string("%d-W%02d", F.year(thursday), F.weekofyear(ts))


def cell_id(lat: Column, lon: Column, res: float = 0.1) -> Column:
    text = F.format_string(f"g{res:.3f}_r%d_c%d", F.floor((lat + 90) / res).cast("long"), F.floor((lon + 180) / res).cast("long"))
    return F.when(lat.isNotNull() & lon.isNotNull(), text).otherwise("unmapped")


def cell_part(cell: Column, part: int) -> Column:
    """1: resolution, 2: row, 3: column; null if the id has another form."""
    return F.nullif(F.regexp_extract(cell, CELL, part), F.lit("")).try_cast("double")


def cell_centroid(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a cell, from its id."""
    res = cell_part(cell, 1)
    return (cell_part(cell, 2) + 0.5) * res - 90, (cell_part(cell, 3) + 0.5) * res - 180


def centroid_or_default(lat: Column, lon: Column, cell: Column, default: tuple[float, float] = (59.5, 20.0)) -> tuple[Column, Column]:
    by_id = cell_centroid(cell)
    return F.coalesce(clean(lat), by_id[0], F.lit(default[0])), F.coalesce(clean(lon), by_id[1], F.lit(default[1]))


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def to_number(x: Column) -> Column:
    """Numbers of a text column; what does not parse, NaN and infinities are null."""
    return clean(F.trim(x).try_cast("double"))


def week_cycle(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the week of the year, over 53 weeks."""
    angle = 2 * math.pi * (F.weekofyear(ts) - 1) / 53
    return F.sin(angle), F.cos(angle)


def season(ts: Column) -> Column:
    return F.when(F.month(ts).isin(11, 12, 1, 2, 3), "winter").when(ts.isNotNull(), "non_winter")


def safe_ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, F.nullif(y, F.lit(0)))


def band(x: Column, edges: list[float], labels: list[str], *, closed: str = "left", last_closed: bool = False, other: str | None = None) -> Column:
    """The label of the interval that holds ``x``.

    ``edges`` are the bounds between and around the labels; an infinite last edge leaves the top open.  Intervals are
    closed on the left or on the right; ``last_closed`` closes the last one on both sides; outside and null give
    ``other``.
    """
    out = F.lit(other)
    for k in reversed(range(len(labels))):
        lo, hi = edges[k], edges[k + 1]
        inside = (x >= lo if closed == "left" else x > lo) if lo != -math.inf else F.lit(True)
        last = last_closed and k == len(labels) - 1
        if hi != math.inf:
            inside = inside & (x <= hi if closed == "right" or last else x < hi)
        out = F.when(inside & x.isNotNull(), labels[k]).otherwise(out)
    return out


#: The distance schemes in use (edges, labels, closed side, whether the last is closed).
SCHEMES = {
    "coast": ([0, 3, 7, 15, 30], ["0-3", "3-7", "7-15", "15-30"], "left", True),
    "near_far": ([0, 3, 10, 50, math.inf], ["0-3", "3-10", "10-50", ">50"], "left", False),
    "hundred": ([0, 10, 50, 100, math.inf], ["0-10", "10-50", "50-100", "100+"], "left", False),
    "inland": ([0, 3, 10, 30, math.inf], ["0-3", "3-10", "10-30", "30-max"], "left", False),
    "fine": ([-math.inf, 5, 10, 20, 50, math.inf], ["0-5", "5-10", "10-20", "20-50", ">50"], "right", False),
    "decades": ([0, 10, 25, 50, 100, math.inf], ["0-10", "10-25", "25-50", "50-100", ">100"], "left", False),
}


def distance_band(x: Column, scheme: str, other: str | None = None) -> Column:
    edges, labels, closed, last = SCHEMES[scheme]
    return band(x, edges, labels, closed=closed, last_closed=last, other=other)


def exposure_score(km: Column) -> Column:
    """1 to 10 km, 0.5 to 50 km, then 0.1 with exponential decay; a null distance scores 0."""
    return F.when(km <= 10, 1.0).when(km <= 50, 0.5).when(km.isNotNull(), 0.1 * F.exp(-(km - 50) / 100)).otherwise(0.0)


def exposure_band(km: Column) -> Column:
    return F.when(km <= 10, "high").when(km <= 50, "medium").when(km.isNotNull(), "low").otherwise("unknown")


def port_exposure(traffic: Column, km: Column) -> Column:
    return traffic / (1 + km)


def decayed_pressure(traffic: Column, km: Column, scale: float = 100.0) -> Column:
    return traffic * F.exp(-km / scale)


def proximity(km: Column) -> Column:
    return 1 / (1 + km)


def log1p_guarded(x: Column) -> Column:
    """log(1 + x) with negatives raised to 0."""
    return F.log1p(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def out_of_range(x: Column, limit: float = 1.0001) -> Column:
    return F.coalesce(F.abs(x) > limit, F.lit(False))


def request_signature(params: Column) -> Column:
    """SHA-256 of the JSON of a map's entries in key order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params)))), 256)


def strength(r: Column, scheme: str = "plain") -> Column:
    """A word for a correlation.  Schemes differ in cut-offs; ``signed`` also tells the sign."""
    a = F.abs(r)
    if scheme == "signed":
        word = F.when(a >= 0.6, "strong").when(a >= 0.3, "moderate").otherwise("weak")
        return F.when(r.isNotNull(), F.concat(word, F.when(r >= 0, " positive").otherwise(" negative")))
    cuts = {"plain": (0.7, 0.4, 0.2), "lenient": (0.5, 0.3, 0.1), "evidence": (0.4, 0.2, 0.1)}[scheme]
    return F.when(a >= cuts[0], "strong").when(a >= cuts[1], "moderate").when(a >= cuts[2], "weak").when(r.isNotNull(), "negligible").otherwise("insufficient")


def reliability(r: Column, n: Column) -> Column:
    return F.when(n < 10, "insufficient").when((n >= 30) & (F.abs(r) >= 0.3), "reliable").otherwise("tentative")


def coverage_tier(percent: Column) -> Column:
    return F.when(percent > 80, "strong").when(percent > 50, "moderate").when(percent > 20, "weak").otherwise("very weak")


def eligible(km: Column, port: Column, base: float = 100.0, larger: float = 200.0, ports: list[str] = ()) -> Column:
    """Within the base distance, or within a larger one for the listed ports."""
    return (km <= base) | ((km <= larger) & port.isin(list(ports)))
