"""Slow row-by-row definitions, written from the rules, to check the Spark jobs on random input."""

from __future__ import annotations

import math
from collections import Counter


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    partner: dict[int, int] = {}
    for i, char in enumerate(a):
        options = [j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if b[j] == char and j not in partner.values()]
        if options:
            partner[i] = options[0]
    m = len(partner)
    if not m:
        return 0.0
    swaps = sum(a[i] != b[j] for i, j in zip(sorted(partner), sorted(partner.values()))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro < 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def pair_score(s: dict, v: dict) -> float:
    if not s["last"] or not v["last"]:
        name = 0.0
    else:
        if s["first"] and s["first"] == v["first"]:
            first = 1.0
        elif s["first"] and v["first"] and s["first"][0] == v["first"][0] and 1 in (len(s["first"]), len(v["first"])):
            first = 0.85
        else:
            first = jaro_winkler(s["first"], v["first"])
        name = 0.6 * jaro_winkler(s["last"], v["last"]) + 0.4 * first
    same = lambda k: 0.5 if not s[k] or not v[k] else float(s[k] == v[k])
    street = jaro_winkler(s["street"], v["street"]) if s["street"] and v["street"] else 0.5
    return 0.65 * name + 0.35 * (0.5 * same("number") + 0.35 * street + 0.15 * same("zip5"))


def best_match(s: dict, voters: list[dict]) -> tuple[float, str | None, int]:
    """(score, voter id, candidates) over voters in roll order; a repeated id counts once per block."""
    seen, best, best_id = set(), -math.inf, None
    for v in voters:
        if v["last"][:3] != s["last"][:3] or v["id"] in seen:
            continue
        seen.add(v["id"])
        score = pair_score(s, v)
        if score > best:
            best, best_id = score, v["id"]
    return (best, best_id, len(seen)) if seen else (0.0, None, 0)


def window_score(content: str, quote: str) -> float:
    words, wanted = content.split(" "), quote.split(" ")
    if len(wanted) < 2:
        return 0.0
    grams = lambda t: Counter(zip(t, t[1:]))
    count = Counter(words)
    present = [w for w in wanted if count[w]]
    if not present:
        return 0.0
    low = min(count[w] for w in present)
    anchor = max((w for w in present if count[w] == low), key=len)
    need, best = grams(wanted), 0.0
    for p in (i for i, w in enumerate(words) if w == anchor):
        for length in (len(wanted), len(wanted) + 3):
            for start in range(max(0, p - length + 1), p + 1):
                have = grams(words[start:start + length])
                shared = sum(min(n, have[g]) for g, n in need.items())
                total = sum(need.values())
                best = max(best, 2 * shared / (total + sum(have.values())), shared / total)
    return best
