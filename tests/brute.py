"""Plain loops that define the expected results."""

import math

EARTH = 3958.7613


def miles(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (
        math.sin(math.radians(lat2 - lat1) / 2) ** 2
        + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * EARTH * math.asin(math.sqrt(min(1.0, a)))


def pairs(areas, sites, radius):
    """Areas are (geoid, lat, lon, population), sites (site_id, lat, lon)."""
    return sorted(
        (s[0], a[0]) for s in sites for a in areas if miles(s[1], s[2], a[1], a[2]) <= radius
    )


def greedy(areas, sites, radius, k):
    """Picks as (site_id, gain), in order."""
    sites = sorted(sites)
    near = [{i for i, a in enumerate(areas) if miles(s[1], s[2], a[1], a[2]) <= radius} for s in sites]
    covered, picks = set(), []
    while len(picks) < k:
        gains = [sum(areas[i][3] for i in n - covered) for n in near]
        best = max(gains, default=0)
        if best <= 0:
            break
        at = gains.index(best)
        picks.append((sites[at][0], best))
        covered |= near[at]
    return picks, covered
