"""A tiny city written as input files, and its feature tables worked out by loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from loops import fill_series, fill_traffic, poi_totals

from zonecast import GridConfig
from zonecast.config import POI_COLUMNS, POI_DIVISORS

CFG = GridConfig(slot_seconds=6 * 3600, n_zones=4)
ZONES = {f"h{z}": z for z in range(1, 5)}
DAYS = [dt.date(2016, 1, d) for d in (1, 2, 10)]
POI = {
    "h1": ["1#2:10", "", "4:7", "19#1:3", "9:5", "1#21:100", "1#2:11"],
    "h2": ["25#5:6"],
    "h4": [],
}


def slot(t: dt.datetime) -> int:
    return (t.hour * 3600 + t.minute * 60 + t.second) // CFG.slot_seconds + 1


class World:
    def __init__(self, seed: int = 7):
        rng = random.Random(seed)
        self.orders, self.traffic, self.weather = [], [], []

        def moment(day):
            return dt.datetime.combine(day, dt.time()) + dt.timedelta(seconds=rng.randrange(86_400))

        for day in DAYS:
            for k in range(60):
                driver = "NULL" if rng.random() < 0.6 else f"d{k}"
                start = f"h{rng.randint(1, 4)}"
                dest = rng.choice(["h1", "h2", "h3", "h4", "nowhere"])
                self.orders.append((f"o{k}", driver, f"p{k}", start, dest, 1.5, moment(day)))
        # day 2 has no traffic at all, day 3 none in zone 1; two rows may share a cell
        for day, zones in ((DAYS[0], [1, 3]), (DAYS[2], [2, 3])):
            times = sorted({moment(day) for _ in range(9)})
            for t in times:
                levels = [f"{i}:{rng.randint(1, 2000)}" for i in (1, 2, 3, 4)]
                self.traffic.append((f"h{rng.choice(zones)}", *levels, t))
        for day in (DAYS[1], DAYS[2]):
            for t in sorted({moment(day) for _ in range(3)}):
                self.weather.append((t, rng.randint(1, 9), rng.uniform(-9, 20), rng.uniform(1, 200)))

    def write(self, folder) -> dict[str, str]:
        """One file per day, named by its date, as the readers expect them."""

        def text(v):
            return v.strftime("%Y-%m-%d %H:%M:%S") if isinstance(v, dt.datetime) else str(v)

        paths = {}
        for name, rows, at in (("orders", self.orders, 6), ("traffic", self.traffic, 5), ("weather", self.weather, 0)):
            (folder / name).mkdir()
            for day in DAYS:
                mine = [r for r in rows if r[at].date() == day]
                lines = ["\t".join(text(v) for v in r) + "\n" for r in mine]
                (folder / name / f"{name}_data_{day}").write_text("".join(lines))
            paths[name] = str(folder / name)
        (folder / "zones").write_text("".join(f"{h}\t{z} \n" for h, z in ZONES.items()))
        (folder / "poi").write_text("".join("\t".join([h, *t]) + "\n" for h, t in POI.items()))
        return paths | {"zones": str(folder / "zones"), "poi": str(folder / "poi")}

    # -- by loops -------------------------------------------------------------

    def gap_counts(self):
        return Counter(
            (t.date(), slot(t), ZONES[s], ZONES.get(d, 0))
            for _, driver, _, s, d, _, t in self.orders
            if driver == "NULL"
        )

    def traffic_cells(self):
        """Later rows overwrite earlier ones of the same cell."""
        out = {}
        for h, *levels, t in sorted(self.traffic, key=lambda r: r[-1]):
            out[t.date(), slot(t), ZONES[h]] = tuple(int(v.split(":")[1]) for v in levels)
        return out

    def weather_cells(self):
        return {(t.date(), slot(t)): (w, c, p) for t, w, c, p in sorted(self.weather)}

    def weather_filled(self, raw):
        out = {}
        for day in DAYS:
            seen = {}
            for (d, s), (w, c, p) in self.weather_cells().items():
                if d == day:
                    seen[s] = (w, max(c, 0.0), p) if raw else (w, (20.0 + c) / 40.0, p / 100.0)
            filled, _ = fill_series(CFG.n_slots, seen, (0, 0.0, 0.0))
            out |= {(day, s): v for s, v in filled.items()}
        return out

    def poi(self, raw):
        return {
            ZONES[h]: tuple(poi_totals(t, None if raw else POI_DIVISORS)[int(c)] for c in POI_COLUMNS)
            for h, t in POI.items()
        }

    def gap_matrix(self, mode, scored=None):
        gaps, poi = self.gap_counts(), self.poi(mode == "raw")
        weather, cells = self.weather_filled(mode == "raw"), self.traffic_cells()
        rows = {}
        for day in DAYS:
            mine = {(s, z): v for (d, s, z), v in cells.items() if d == day}
            traffic = fill_traffic(CFG.n_slots, CFG.n_zones, mine, (0, 0, 0, 0))
            if mode != "raw":
                traffic = {k: self.scaled(v) for k, v in traffic.items()}
            if mode == "test":
                traffic = {}
                for (d, s, z), (seen, guess) in scored.items():
                    if d == day:
                        traffic[s, z] = tuple(g / 4.0 if v is None else v for v, g in zip(seen, guess, strict=True))
            for s in range(1, CFG.n_slots + 1):
                for z in range(1, CFG.n_zones + 1):
                    for d in range(CFG.n_zones + 1):
                        rows[day, s * 10000 + z * 100 + d] = (
                            s, z, d, day.day % 7, gaps.get((day, s, z, d), 0),
                            *traffic.get((s, z), (None,) * 4),
                            *weather[day, s],
                            *poi.get(z, (None,) * len(POI_COLUMNS)),
                        )
        return rows

    @staticmethod
    def scaled(v):
        return (v[0] / 2000.0, v[1] / 1000.0, v[2] / 400.0, v[3] / 200.0)
