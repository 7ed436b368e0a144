"""The same semantics as plain loops over dicts, for comparison on small inputs."""

from __future__ import annotations


def fill_series(n_slots, seen, carry):
    """(filled dict, carry after): carry is the value the loop holds, not reset between calls."""
    for s in range(1, n_slots + 1):
        carry = seen.get(s, carry)
    out = {}
    for s in range(1, n_slots + 1):
        carry = seen.get(s, carry)
        out[s] = carry
    return out, carry


def fill_traffic(n_slots, n_zones, seen, zero):
    """seen: {(slot, zone): value} of one day."""
    carry, out = zero, {}
    for z in range(1, n_zones + 1):
        mine = {s: v for (s, zz), v in seen.items() if zz == z}
        filled, carry = fill_series(n_slots, mine, carry)
        out |= {(s, z): v for s, v in filled.items()}
    return out


def poi_totals(tokens, scaled_by=None):
    """tokens: list of 'key:n' in order, blanks allowed."""
    seen = {}
    for t in tokens:
        if t:
            k, n = t.split(":")[:2]
            seen[k] = int(n)
    out = {}
    for c in range(1, 26):
        total = seen.get(str(c), 0) + sum(seen.get(f"{c}#{j}", 0) for j in range(1, 21))
        out[c] = total / (scaled_by[c][0] / scaled_by[c][1]) if scaled_by else total
    return out
