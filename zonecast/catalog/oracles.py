"""Check queries for DuckDB, written apart from the DataFrame code they check."""

from __future__ import annotations

from ..config import POI_CATEGORIES, POI_COLUMNS, POI_DIVISORS
from ..fixtures import VIEWS
from ..sources.zone_table import ZONE_HASHES

PARTS: dict[str, str] = {k: v.replace("{", "").replace("}", "") for k, v in VIEWS.items()}

SLOT = "CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 600) + 1 AS INT)"


def _poi_sum(c: int, scaled: bool) -> str:
    total = f"coalesce(sum(n) FILTER (cat = {c} AND sub <= 20), 0)"
    if not scaled:
        return f'CAST({total} AS BIGINT) AS "{c}"'
    a, b = POI_DIVISORS[c]
    return f'CAST({total} AS DOUBLE) / (CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)) AS "{c}"'


def _fill(cols: list[str], carry: str) -> str:
    def one(c: str) -> str:
        return (
            f"coalesce(last_value(o.{c} IGNORE NULLS) OVER w, {carry.format(c=c)}, 0) AS {c}"
        )

    return ", ".join(one(c) for c in cols)


def _traffic_fill(cols: list[str], source: str, leak: bool) -> str:
    """Per zone the last observation, carried upwards over zones; then down the slots."""
    last = ", ".join(f"max_by({c}, slot) AS {c}" for c in cols)
    carried = ", ".join(
        f"last_value(l.{c} IGNORE NULLS) OVER z AS {c}" if leak else f"l.{c}" for c in cols
    )
    return f"""
SELECT g.date, g.slot, g.zone, {_fill(cols, "k.{c}")}
FROM zone_grid g
LEFT JOIN {source} o ON g.date = o.date AND g.slot = o.slot AND g.zone = o.zone
JOIN (SELECT d.date, d.zone, {carried}
      FROM (SELECT date, zone FROM days, (SELECT unnest(range(1, 67)) AS zone) z) d
      LEFT JOIN (SELECT date, zone, {last} FROM {source} GROUP BY date, zone) l
        ON d.date = l.date AND d.zone = l.zone
      WINDOW z AS (PARTITION BY d.date ORDER BY d.zone ROWS UNBOUNDED PRECEDING)) k
  ON g.date = k.date AND g.zone = k.zone
WINDOW w AS (PARTITION BY g.date, g.zone ORDER BY g.slot ROWS UNBOUNDED PRECEDING)"""


def _weather_fill(temp: str, pollution: str) -> str:
    cols = ["weather", "temp", "pollution"]
    wrap = "last_value(o.{c} IGNORE NULLS) OVER a"
    return f"""
SELECT g.date, g.slot, {_fill(cols, wrap)}
FROM slot_grid g
LEFT JOIN (SELECT date, slot, weather, {temp} AS temp, {pollution} AS pollution FROM weather_last) o
  ON g.date = o.date AND g.slot = o.slot
WINDOW w AS (PARTITION BY g.date ORDER BY g.slot ROWS UNBOUNDED PRECEDING),
       a AS (PARTITION BY g.date ORDER BY g.slot
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


LV = ["t1", "t2", "t3", "t4"]
STALE = ["src_day", "src_zone", "src_slot", *LV]
SCALED = "t1 / 2000.0 AS t1, t2 / 1000.0 AS t2, t3 / 400.0 AS t3, t4 / 200.0 AS t4"
TEMP, POLL = "(20.0 + temp) / 40.0", "pollution / 100.0"
POI_Q = ", ".join(f'p."{c}"' for c in POI_COLUMNS)

PARTS |= {
    "days": "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events",
    "slot_grid": "SELECT date, slot FROM days, (SELECT CAST(unnest(range(1, 145)) AS INT) AS slot) s",
    "zone_grid": "SELECT date, slot, zone FROM slot_grid, "
    "(SELECT CAST(unnest(range(1, 67)) AS INT) AS zone) z",
    "od_grid": "SELECT date, slot, zone AS origin, dest FROM zone_grid, "
    "(SELECT CAST(unnest(range(0, 67)) AS INT) AS dest) d",
    "orders_keyed": f"""
SELECT CAST(ts AS DATE) AS date, {SLOT} AS slot, a.zone_id AS origin,
       coalesce(b.zone_id, 0) AS dest, driver_id, event_id
FROM ride_orders r JOIN zones a ON r.start_hash = a.zone_hash
LEFT JOIN zones b ON r.dest_hash = b.zone_hash""",
    "gaps": """
SELECT date, slot, origin, dest, count(*) AS gap FROM orders_keyed
WHERE driver_id = 'NULL' GROUP BY ALL""",
    "traffic_rows": f"""
SELECT CAST(ts AS DATE) AS date, {SLOT} AS slot, zone_id AS zone, ts, event_id,
       CAST(split_part(level1, ':', 2) AS INT) AS t1, CAST(split_part(level2, ':', 2) AS INT) AS t2,
       CAST(split_part(level3, ':', 2) AS INT) AS t3, CAST(split_part(level4, ':', 2) AS INT) AS t4
FROM traffic_raw JOIN zones USING (zone_hash)""",
    "traffic_last": """
SELECT date, slot, zone, t1, t2, t3, t4 FROM traffic_rows
QUALIFY row_number() OVER (PARTITION BY date, slot, zone ORDER BY ts DESC, event_id DESC) = 1""",
    "traffic_keyed": """
SELECT *, CAST(day(date) % 7 AS INT) AS src_day, zone AS src_zone, slot AS src_slot FROM traffic_last""",
    "weather_last": f"""
SELECT CAST(ts AS DATE) AS date, {SLOT} AS slot, weather, temperature AS temp, pollution
FROM weather_raw
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), {SLOT} ORDER BY ts DESC, event_id DESC) = 1""",
    "traffic_fill": _traffic_fill(LV, "traffic_last", True),
    "traffic_fill_flat": _traffic_fill(LV, "traffic_last", False),
    "traffic_fill_stale": _traffic_fill(STALE, "traffic_keyed", True),
    "weather_fill": _weather_fill(TEMP, POLL),
    "weather_fill_raw": _weather_fill("CASE WHEN temp < 0 THEN 0.0 ELSE temp END", "pollution"),
    "poi_parsed": r"""
SELECT zone, cat, sub, max_by(n, pos) AS n FROM (
  SELECT zone_id AS zone, pos,
         CAST(regexp_extract(token, '^([0-9]+)', 1) AS INT) AS cat,
         CASE WHEN token LIKE '%#%' THEN CAST(regexp_extract(token, '#([0-9]+)', 1) AS INT) ELSE 0 END AS sub,
         CAST(regexp_extract(token, ':([0-9]+)$', 1) AS INT) AS n
  FROM poi_tokens_raw JOIN zones USING (zone_hash)) t
GROUP BY zone, cat, sub""",
    "poi_wide": "SELECT zone, "
    + ", ".join(_poi_sum(c, False) for c in POI_CATEGORIES)
    + " FROM poi_parsed GROUP BY zone",
    "poi_scaled": "SELECT zone, "
    + ", ".join(_poi_sum(c, True) for c in POI_CATEGORIES)
    + " FROM poi_parsed GROUP BY zone",
    "traffic_grid": f"""
SELECT g.date, g.slot, g.zone, {SCALED}
FROM zone_grid g LEFT JOIN traffic_last o USING (date, slot, zone)""",
    "scored_traffic": """
SELECT date, slot, zone, t1, t2, t3, t4,
       slot / 100.0 + zone / 10.0 AS t1p, slot / 50.0 AS t2p, zone / 20.0 AS t3p, slot % 7 + zone / 8.0 AS t4p
FROM traffic_grid""",
    "rollup": """
SELECT day, slot, zone, CAST(sum(gap) AS BIGINT) AS gap,
       sum(CASE WHEN predict < 0.5 THEN 0.0 ELSE predict END) AS predict
FROM scored_cells GROUP BY day, slot, zone""",
    "rollup_plain": """
SELECT day, slot, zone, CAST(sum(gap) AS BIGINT) AS gap, sum(predict) AS predict
FROM scored_cells GROUP BY day, slot, zone""",
    "lagged": """
SELECT * FROM (
  SELECT key, t, x, y, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(x, 1) OVER w AS x1,
         lag(x, 2) OVER w AS x2
  FROM daily_series WINDOW w AS (PARTITION BY key ORDER BY t)) l""",
}

DEPS = {
    "slot_grid": ["days"],
    "zone_grid": ["slot_grid"],
    "od_grid": ["zone_grid"],
    "orders_keyed": ["ride_orders", "zones"],
    "gaps": ["orders_keyed"],
    "traffic_rows": ["traffic_raw", "zones"],
    "traffic_last": ["traffic_rows"],
    "traffic_keyed": ["traffic_last"],
    "weather_last": ["weather_raw"],
    "traffic_fill": ["zone_grid", "traffic_last"],
    "traffic_fill_flat": ["zone_grid", "traffic_last"],
    "traffic_fill_stale": ["zone_grid", "traffic_keyed"],
    "weather_fill": ["slot_grid", "weather_last"],
    "weather_fill_raw": ["slot_grid", "weather_last"],
    "poi_parsed": ["poi_tokens_raw", "zones"],
    "poi_wide": ["poi_parsed"],
    "poi_scaled": ["poi_parsed"],
    "traffic_grid": ["zone_grid", "traffic_last"],
    "scored_traffic": ["traffic_grid"],
    "rollup": ["scored_cells"],
    "rollup_plain": ["scored_cells"],
    "lagged": ["daily_series"],
}


def _with(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for d in DEPS.get(name, []):
            visit(d)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n].strip()})" for n in order)
    return f"WITH {ctes}\n{body}" if order else body


# -- digests of the dense tables ----------------------------------------------

DAY = "CAST({}date AS VARCHAR) AS date"
IN_TRAIN = "('0x' || substr(md5(CAST({} AS VARCHAR) || '|' || CAST({} AS VARCHAR)), 1, 8))::BIGINT % 1000 < 800"


def _micro(cols: list[str]) -> str:
    return ", ".join(
        f'CAST(sum(CAST(round("{c}" * 1e6) AS BIGINT)) AS BIGINT) AS "s_{c}"' for c in cols
    )


def _slot_micro(cols: list[str]) -> str:
    return ", ".join(
        f'CAST(sum(CAST(round("{c}" * 1e6) AS BIGINT) * timeslice) AS BIGINT) AS "p_{c}"' for c in cols
    )


GAP_MEASURES = ["traffic1", "traffic2", "traffic3", "traffic4", "temp", "pollution", *POI_COLUMNS]


def _gap_digest(traffic: str, weather: str, poi: str) -> str:
    body = f"""
SELECT {DAY.format('')}, "districtID", count(*) AS n, CAST(sum(id) AS BIGINT) AS s_id,
       CAST(min(day) AS INT) AS day, CAST(sum(gap) AS BIGINT) AS s_gap,
       CAST(sum(gap * id) AS BIGINT) AS s_gap_id, CAST(sum(gap * "destDistrict") AS BIGINT) AS s_gap_dest,
       CAST(sum(weather * timeslice) AS BIGINT) AS s_weather,
       count(traffic1) AS n_traffic, {_micro(GAP_MEASURES)}, {_slot_micro(GAP_MEASURES[:6])}
FROM (SELECT g.date, g.slot AS timeslice, g.origin AS "districtID", g.dest AS "destDistrict",
             g.slot * 10000 + g.origin * 100 + g.dest AS id, day(g.date) % 7 AS day,
             coalesce(c.gap, 0) AS gap, t.t1 AS traffic1, t.t2 AS traffic2, t.t3 AS traffic3,
             t.t4 AS traffic4, w.weather, w.temp, w.pollution, {POI_Q}
      FROM od_grid g
      LEFT JOIN gaps c ON g.date = c.date AND g.slot = c.slot AND g.origin = c.origin AND g.dest = c.dest
      LEFT JOIN ({traffic}) t ON g.date = t.date AND g.slot = t.slot AND g.origin = t.zone
      LEFT JOIN {weather} w ON g.date = w.date AND g.slot = w.slot
      LEFT JOIN {poi} p ON g.origin = p.zone) m
GROUP BY date, "districtID\""""
    return body


def _traffic_rows(cells: str, day: str, zone: str, slot: str) -> str:
    return f"""
SELECT {DAY.format('t.')}, CAST({day} AS INT) AS day, {zone} AS district, {slot} AS timeslice,
       {', '.join(f'round(t.{c}, 6) AS {c}' for c in LV)}, round(w.temp, 6) AS temp,
       round(w.pollution, 6) AS pollution, {', '.join(f'round(p."{c}", 9) AS "{c}"' for c in POI_COLUMNS)}
FROM ({cells}) t
LEFT JOIN weather_fill w ON t.date = w.date AND t.slot = w.slot
LEFT JOIN poi_scaled p ON t.zone = p.zone"""


def _scale_of(name: str, extra: str = "") -> str:
    return f"SELECT date, slot, zone, {extra}{SCALED} FROM {name}"


# -- regression by successive orthogonalisation -------------------------------


def _granger_l2(with_p: bool) -> str:
    """Sweep each regressor out of the ones after it, within each key.

    With two restrictions the tail of F has a closed form.
    """
    names = ["y", "y1", "y2", "x1", "x2"]
    ctes = [
        "s0 AS MATERIALIZED (SELECT key, "
        + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY key) AS {c}" for c in names)
        + " FROM lagged WHERE y2 IS NOT NULL)"
    ]
    remaining = ["y1", "y2", "x1", "x2"]
    step = 0
    for pivot in list(remaining):
        rest = ["y", *remaining[remaining.index(pivot) + 1 :]]
        cols = ", ".join(
            f"{c} - {pivot} * (sum({c} * {pivot}) OVER k / sum({pivot} * {pivot}) OVER k) AS {c}"
            for c in rest
        )
        keep = ", y0" if step else ", y AS y0"
        own = ", yr" if step > 2 else ""
        if step == 2:
            own = ", y AS yr"
        ctes.append(
            f"s{step + 1} AS MATERIALIZED (SELECT key{keep}{own}, {cols} FROM s{step} "
            "WINDOW k AS (PARTITION BY key))"
        )
        step += 1
    p = ", round(pow(1 + 2 * f / (n - 5), -(n - 5) / 2.0), 6) AS p" if with_p else ""
    body = f"""
SELECT key, n, round(f, 6) AS f, round(r2, 6) AS r2{p}
FROM (SELECT key, n, ((rss0 - rss1) / 2) / (rss1 / (n - 5)) AS f, 1 - rss1 / tss AS r2
      FROM (SELECT key, count(*) AS n, sum(y0 * y0) AS tss, sum(yr * yr) AS rss0, sum(y * y) AS rss1
            FROM s4 GROUP BY key) q) r"""
    head = _with(["lagged"], "")
    return head.rstrip() + ",\n" + ",\n".join(ctes) + body


def _zone_values() -> str:
    return ", ".join(f"('{h}', {i})" for i, h in enumerate(ZONE_HASHES, start=1))


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    # scalars
    q["slot_of_day"] = f"SELECT event_id, {SLOT} AS slot FROM events"
    q["day_mod7"] = "SELECT event_id, CAST(day(ts) % 7 AS INT) AS day FROM events"
    q["day_label"] = "SELECT event_id, strftime(ts, '%d') AS label FROM events"
    idx = "slot * 10000 + zone * 100 + dest"
    q["od_encode"] = _with(
        ["scored_cells"], f"SELECT day, slot, zone, dest, CAST({idx} AS INT) AS id FROM scored_cells"
    )
    q["od_decode"] = _with(
        ["scored_cells"],
        f"SELECT CAST({idx} AS INT) AS id, slot, zone AS origin, dest FROM scored_cells",
    )
    q["zone_slot_key"] = _with(
        ["scored_cells"], "SELECT slot, zone, CAST(slot * 100 + zone AS INT) AS k FROM scored_cells"
    )
    q["level_parse"] = _with(["traffic_rows"], "SELECT event_id, t1, t2, t3, t4 FROM traffic_rows")
    q["slot_label"] = f"""
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) || '_' || CAST({SLOT} AS VARCHAR) AS label,
       CAST(CAST(ts AS DATE) AS VARCHAR) || '_' AS from_name FROM events"""
    q["temp_clamp"] = _with(
        ["weather_raw"],
        "SELECT event_id, round(CASE WHEN temperature < 0 THEN 0 ELSE temperature END, 6) AS temp "
        "FROM weather_raw",
    )
    q["weather_scale"] = _with(
        ["weather_last"],
        f"SELECT {DAY.format('')}, slot, weather, round({TEMP}, 6) AS temp, "
        f"round({POLL}, 6) AS pollution FROM weather_last",
    )
    q["traffic_scale"] = _with(
        ["traffic_last"], f"SELECT {DAY.format('')}, slot, zone, {SCALED} FROM traffic_last"
    )
    obs = ", ".join(f"round(coalesce({t}, {t}p / 4.0), 6) AS {t}" for t in LV)
    q["observed_or_predicted"] = _with(
        ["scored_traffic"], f"SELECT {DAY.format('')}, slot, zone, {obs} FROM scored_traffic"
    )
    q["pred_threshold"] = _with(
        ["scored_cells"],
        "SELECT day, slot, zone, dest, gap, "
        "CASE WHEN predict < 0.5 THEN 0.0 ELSE predict END AS predict FROM scored_cells",
    )
    q["abs_error"] = _with(
        ["scored_cells"],
        "SELECT day, slot, zone, dest, round(abs(predict - gap), 6) AS err FROM scored_cells",
    )

    # quality
    q["drop_all_null"] = """
SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id END AS id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind
FROM events WHERE NOT (event_id % 6 = 0 AND event_id % 4 = 0)"""
    q["invalid_slots"] = f"""
SELECT count(*) AS n_rows, count(*) FILTER ({SLOT} < 1 OR {SLOT} > 100) AS n_invalid
FROM events"""
    q["unserved_orders"] = "SELECT event_id FROM events WHERE event_type = 'error'"
    q["unknown_zone_rejects"] = _with(
        ["ride_orders", "zones"],
        "SELECT event_id, dest_hash FROM ride_orders "
        "WHERE dest_hash NOT IN (SELECT zone_hash FROM zones)",
    )
    q["stage_counts"] = _with(
        ["ride_orders", "gaps", "traffic_raw", "traffic_last", "traffic_fill", "weather_raw"],
        """
SELECT 'orders' AS stage, count(*) AS n_rows FROM ride_orders
UNION ALL SELECT 'unserved', count(*) FROM ride_orders WHERE driver_id = 'NULL'
UNION ALL SELECT 'gap_cells', count(*) FROM gaps
UNION ALL SELECT 'traffic', count(*) FROM traffic_raw
UNION ALL SELECT 'traffic_cells', count(*) FROM traffic_last
UNION ALL SELECT 'traffic_filled', count(*) FROM traffic_fill
UNION ALL SELECT 'weather', count(*) FROM weather_raw""",
    )
    q["observed_count"] = "SELECT count(*) AS n_rows FROM events WHERE event_type = 'error'"
    q["const_columns"] = """
SELECT 'event_id' AS name, min(event_id) = max(event_id) AS is_const FROM events
UNION ALL SELECT 'value', min(value) = max(value) FROM events
UNION ALL SELECT 'n_levels', true
UNION ALL SELECT 'nothing', true"""

    # dimensions and joins
    q["zone_map"] = _with(
        ["zone_log"], "SELECT zone_hash, arg_max(zone_id, pos) AS zone_id FROM zone_log GROUP BY zone_hash"
    )
    q["zone_dim_usage"] = (
        f"SELECT zone_hash, zone_id, count(*) AS n FROM (VALUES {_zone_values()}) z(zone_hash, zone_id) "
        "JOIN events ON user_id % 66 + 1 = zone_id GROUP BY zone_hash, zone_id"
    )
    q["zone_lookup"] = _with(
        ["orders_keyed"], "SELECT event_id, origin, dest FROM orders_keyed"
    )
    q["day_select"] = _with(
        ["ride_orders"],
        "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM ride_orders "
        "WHERE day(ts) IN (22, 24, 26, 28, 30)",
    )

    # aggregations
    q["gap_counts"] = _with(["gaps"], f"SELECT {DAY.format('')}, slot, origin, dest, gap FROM gaps")
    q["served_total"] = _with(
        ["ride_orders"],
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, "
        "count(*) FILTER (driver_id <> 'NULL') AS served FROM ride_orders GROUP BY 1",
    )
    q["traffic_last"] = _with(
        ["traffic_last"], f"SELECT {DAY.format('')}, slot, zone, t1, t2, t3, t4 FROM traffic_last"
    )
    q["weather_last"] = _with(
        ["weather_last"],
        f"SELECT {DAY.format('')}, slot, weather, round(temp, 6) AS temp, "
        "round(pollution, 6) AS pollution FROM weather_last",
    )
    q["poi_last"] = _with(
        ["poi_tokens_raw"],
        "SELECT zone_hash, pos, token FROM poi_tokens_raw "
        "QUALIFY row_number() OVER (PARTITION BY zone_hash ORDER BY pos DESC) = 1",
    )
    q["poi_tokens"] = _with(["poi_parsed"], "SELECT zone, cat, sub, n FROM poi_parsed")
    long = " UNION ALL ".join(
        f'SELECT zone, {c} AS cat, {{0}}"{c}"{{1}} AS n FROM {{2}}' for c in POI_CATEGORIES
    )
    q["poi_rollup"] = _with(["poi_wide"], long.format("", "", "poi_wide"))
    q["poi_rollup_scaled"] = _with(["poi_scaled"], long.format("round(", ", 9)", "poi_scaled"))
    q["poi_pivot"] = _with(
        ["poi_scaled"],
        "SELECT zone, " + ", ".join(f'round("{c}", 9) AS "{c}"' for c in POI_COLUMNS) + " FROM poi_scaled",
    )
    q["key_frequency"] = _with(
        ["orders_keyed"], "SELECT origin, count(*) AS n FROM orders_keyed GROUP BY origin"
    )

    # grids and fills
    q["od_grid_gap"] = _with(
        ["od_grid", "gaps"],
        f"""
SELECT {DAY.format('g.')}, g.origin, count(*) AS n, CAST(sum(coalesce(gap, 0)) AS BIGINT) AS gap,
       CAST(sum(coalesce(gap, 0) * (g.slot * 100 + g.dest)) AS BIGINT) AS check_sum
FROM od_grid g LEFT JOIN gaps c
  ON g.date = c.date AND g.slot = c.slot AND g.origin = c.origin AND g.dest = c.dest
GROUP BY g.date, g.origin""",
    )
    q["weather_grid"] = _with(
        ["slot_grid", "weather_last"],
        f"""
SELECT {DAY.format('g.')}, CAST(day(g.date) AS INT) AS day, g.slot AS timeslice, weather,
       round(temp, 6) AS temp, round(pollution, 6) AS pollution
FROM slot_grid g LEFT JOIN weather_last w ON g.date = w.date AND g.slot = w.slot""",
    )
    q["weather_fill"] = _with(
        ["weather_fill"],
        f"SELECT {DAY.format('')}, slot, weather, round(temp, 6) AS temp, "
        "round(pollution, 6) AS pollution FROM weather_fill",
    )
    for name in ("traffic_fill", "traffic_fill_flat"):
        q[name] = _with([name], f"SELECT {DAY.format('')}, slot, zone, t1, t2, t3, t4 FROM {name}")
    q["traffic_fill_stale"] = _with(
        ["traffic_fill_stale"],
        f"SELECT {DAY.format('')}, slot, zone, {', '.join(STALE)} FROM traffic_fill_stale",
    )

    # feature tables
    base = ["od_grid", "gaps"]
    q["features_raw"] = _with(
        [*base, "traffic_fill", "weather_fill_raw", "poi_wide"],
        _gap_digest("SELECT * FROM traffic_fill", "weather_fill_raw", "poi_wide"),
    )
    q["features_norm"] = _with(
        [*base, "traffic_fill", "weather_fill", "poi_scaled"],
        _gap_digest(_scale_of("traffic_fill"), "weather_fill", "poi_scaled"),
    )
    test_levels = ", ".join(f"coalesce({t}, {t}p / 4.0) AS {t}" for t in LV)
    q["features_test"] = _with(
        [*base, "scored_traffic", "weather_fill", "poi_scaled"],
        _gap_digest(
            f"SELECT date, slot, zone, {test_levels} FROM scored_traffic", "weather_fill", "poi_scaled"
        ),
    )
    tables = ["weather_fill", "poi_scaled"]
    q["traffic_train"] = _with(
        [*tables, "traffic_fill"],
        _traffic_rows(_scale_of("traffic_fill"), "day(t.date) % 7", "t.zone", "t.slot"),
    )
    q["traffic_train_stale"] = _with(
        [*tables, "traffic_fill_stale"],
        _traffic_rows(
            _scale_of("traffic_fill_stale", "src_day, src_zone, src_slot, "),
            "t.src_day", "t.src_zone", "t.src_slot",
        ),
    )
    q["traffic_observed"] = _with(
        [*tables, "traffic_last"],
        f"""
SELECT {DAY.format('t.')}, CAST(day(t.date) % 7 AS INT) AS day, t.zone AS district, t.slot AS timeslice,
       {', '.join(f'round(t.{c}, 6) AS {c}' for c in LV)}, round(w.temp, 6) AS temp,
       round(w.pollution, 6) AS pollution, {', '.join(f'round(p."{c}", 9) AS "{c}"' for c in POI_COLUMNS)}
FROM ({_scale_of('traffic_last')}) t
LEFT JOIN weather_fill w ON t.date = w.date AND t.slot = w.slot
LEFT JOIN poi_scaled p ON t.zone = p.zone""",
    )
    q["traffic_predict_grid"] = _with(
        [*tables, "traffic_grid"],
        _traffic_rows("SELECT * FROM traffic_grid", "day(t.date) % 7", "t.zone", "t.slot"),
    )

    # splits and preparation
    q["category_index"] = _with(
        ["scored_cells"],
        """
SELECT slot, zone, n, CAST(dense_rank() OVER (ORDER BY CAST(slot AS VARCHAR)) - 1 AS DOUBLE) AS slot_ix,
       CAST(dense_rank() OVER (ORDER BY CAST(zone AS VARCHAR)) - 1 AS DOUBLE) AS zone_ix
FROM (SELECT slot, zone, count(*) AS n FROM scored_cells GROUP BY slot, zone) c""",
    )
    q["hash_split"] = (
        f"SELECT event_id, {IN_TRAIN.format('CAST(ts AS DATE)', 'event_id')} AS train FROM events"
    )
    q["gap_split"] = _with(
        ["gaps"],
        f"""
SELECT {DAY.format('')}, slot, part, count(*) AS n, CAST(sum(id) AS BIGINT) AS s_id
FROM (SELECT date, slot, id, CASE WHEN {IN_TRAIN.format('date', 'id')} THEN 'train' ELSE 'held out' END AS part
      FROM (SELECT *, slot * 10000 + origin * 100 + dest AS id FROM gaps) g) p
GROUP BY date, slot, part""",
    )
    q["temporal_split"] = """
SELECT event_id, CASE WHEN day(ts) <= 21 THEN 'train' ELSE 'test' END AS part
FROM events WHERE day(ts) <= 21 OR day(ts) IN (22, 24, 26, 28, 30)"""
    q["random_split"] = "SELECT count(*) AS n_rows, 0::BIGINT AS n_twice, true AS share_ok FROM events"
    q["mean_impute"] = _with(
        ["slot_grid", "weather_last"],
        f"""
SELECT {DAY.format('g.')}, g.slot, round(coalesce(temp, avg(temp) OVER ()), 6) AS temp,
       round(coalesce(pollution, avg(pollution) OVER ()), 6) AS pollution
FROM slot_grid g LEFT JOIN weather_last w ON g.date = w.date AND g.slot = w.slot""",
    )

    # forecasts
    roll = "SELECT day, slot, zone, gap, round(predict, 6) AS predict FROM {}"
    q["forecast_rollup"] = _with(["rollup"], roll.format("rollup"))
    q["forecast_rollup_plain"] = _with(["rollup_plain"], roll.format("rollup_plain"))
    q["forecast_mae"] = _with(
        ["rollup_plain"],
        "SELECT day, round(avg(abs(predict - gap)), 6) AS mae FROM rollup_plain GROUP BY day",
    )
    q["forecast_first20"] = _with(
        ["rollup"], roll.format("rollup") + " ORDER BY day, slot, zone LIMIT 20"
    )
    q["union_days"] = _with(
        ["gaps"],
        f"SELECT {DAY.format('')}, slot, origin, dest, gap FROM gaps",
    )
    q["merge_outputs"] = _with(
        ["rollup"],
        "SELECT '2024-01-' || lpad(CAST(day AS VARCHAR), 2, '0') || '_' || CAST(slot AS VARCHAR) AS timeslice, "
        'zone AS "districtID", gap, round(predict, 6) AS predict FROM rollup '
        "WHERE day IN (22, 24, 26, 28, 30)",
    )

    # series
    q["lag_matrix"] = _with(
        ["lagged"],
        "SELECT key, t, x, y, x1 AS x_lag1, x2 AS x_lag2, y1 AS y_lag1, y2 AS y_lag2, "
        "CAST(1 AS DOUBLE) AS const FROM lagged WHERE y2 IS NOT NULL",
    )
    padded = "CASE WHEN n <= 1 THEN n ELSE CAST(pow(2, ceil(log2(n))) AS BIGINT) END"
    q["padded_len"] = _with(
        ["daily_series"],
        f"SELECT key, n, {padded} AS padded FROM (SELECT key, count(*) AS n FROM daily_series GROUP BY key) c",
    )
    dft = f"""
SELECT key, n, padded, bin, {{}} FROM (
  SELECT key, n, padded, bin,
         sqrt(pow(sum(y * cos(2 * pi() * bin * j / padded)), 2)
              + pow(sum(y * sin(2 * pi() * bin * j / padded)), 2)) AS mag
  FROM (SELECT s.key, s.j, s.y, s.n, {padded} AS padded
        FROM (SELECT key, y, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS j,
                     count(*) OVER (PARTITION BY key) AS n FROM daily_series) s) r,
       LATERAL (SELECT unnest(range(0, CAST(padded / 2 AS BIGINT) + 1)) AS bin) b
  GROUP BY key, n, padded, bin) m"""
    q["spectrum"] = _with(["daily_series"], dft.format("round(mag, 6) AS mag"))
    q["power_spectrum"] = _with(
        ["daily_series"], dft.format("round(mag, 6) AS mag, round(mag * mag / padded, 5) AS psd")
    )
    q["tss"] = _with(
        ["daily_series"],
        "SELECT key, round(sum((y - m) * (y - m)), 4) AS tss FROM "
        "(SELECT key, y, avg(y) OVER (PARTITION BY key) AS m FROM daily_series) s GROUP BY key",
    )
    fit = (
        "SELECT key, count(*) AS n, regr_intercept(y, y1) AS intercept, regr_slope(y, y1) AS slope, "
        "regr_r2(y, y1) AS r2 FROM lagged WHERE y1 IS NOT NULL GROUP BY key"
    )
    q["ols_lag1"] = _with(
        ["lagged"],
        f"SELECT key, n, round(intercept, 6) AS intercept, round(slope, 6) AS slope, "
        f"round(r2, 6) AS r2 FROM ({fit}) f",
    )
    q["rss"] = _with(
        ["lagged"],
        f"SELECT l.key, round(sum(pow(y - intercept - slope * y1, 2)), 4) AS rss "
        f"FROM lagged l JOIN ({fit}) f ON l.key = f.key WHERE y1 IS NOT NULL GROUP BY l.key",
    )
    q["granger_l1"] = _with(
        ["lagged"],
        """
SELECT key, n, round((rss0 - rss1) / (rss1 / (n - 3)), 6) AS f, round(1 - rss1 / syy, 6) AS r2
FROM (SELECT key, n, syy, syy - say * say / saa AS rss0,
             syy - (say * say * sbb - 2 * say * sby * sab + sby * sby * saa) / (saa * sbb - sab * sab) AS rss1
      FROM (SELECT key, count(*) AS n, var_pop(y) * count(*) AS syy, var_pop(y1) * count(*) AS saa,
                   var_pop(x1) * count(*) AS sbb, covar_pop(y1, y) * count(*) AS say,
                   covar_pop(x1, y) * count(*) AS sby, covar_pop(y1, x1) * count(*) AS sab
            FROM lagged WHERE y1 IS NOT NULL GROUP BY key) s) r""",
    )
    q["granger_l2"] = _granger_l2(with_p=False)
    q["granger_p"] = _granger_l2(with_p=True)

    # Gaussian naive Bayes of the weather code on day and slot
    q["nb_weather"] = _with(
        ["slot_grid", "weather_last"],
        """
, grid AS MATERIALIZED (
  SELECT CAST(day(g.date) AS INT) AS day, g.slot AS timeslice, weather
  FROM slot_grid g LEFT JOIN weather_last w ON g.date = w.date AND g.slot = w.slot),
codes AS MATERIALIZED (
  SELECT weather AS code, count(*) AS n, avg(day) AS md, var_pop(day) AS vd,
         avg(timeslice) AS ms, var_pop(timeslice) AS vs
  FROM grid WHERE weather IS NOT NULL AND day <= 21 GROUP BY weather)
SELECT day, timeslice, weather, code AS predict FROM grid, codes
WHERE day IN (22, 24, 26, 28, 30)
QUALIFY row_number() OVER (
  PARTITION BY day, timeslice
  ORDER BY ln(n) - 0.5 * (ln(vd) + ln(vs) + pow(day - md, 2) / vd + pow(timeslice - ms, 2) / vs) DESC) = 1""",
    )

    # eight-hour slots: 48 of the ten-minute ones
    def cells(extra: str, label: str, days: str = "22, 24, 26, 28, 30") -> str:
        return _with(
            ["zone_grid", "orders_keyed"],
            f"""
SELECT {label}, g.zone AS "districtID", count(o.event_id) AS gap, true AS {extra}
FROM (SELECT * FROM zone_grid WHERE slot % 48 = 1 AND day(date) IN ({days})) g
LEFT JOIN orders_keyed o ON o.driver_id = 'NULL' AND o.date = g.date AND o.origin = g.zone
  AND o.slot BETWEEN g.slot AND g.slot + 47
GROUP BY g.date, g.slot, g.zone""",
        )

    wide = "CAST((g.slot + 47) / 48 AS INT)"
    named = f"{DAY.format('g.')}, {wide} AS timeslice"
    q["model_roundtrip"] = cells("same", named)
    for name in ("rf_gap_full", "gbt_gap", "mlp_gap"):
        q[name] = cells("in_range", named)
    q["rf_gap_short"] = cells("in_range", named, days="22")
    q["end_to_end_forecast"] = cells(
        "in_range", f"CAST(g.date AS VARCHAR) || '_' || CAST({wide} AS VARCHAR) AS timeslice"
    )
    q["rf_gap_raw"] = (
        f"SELECT DISTINCT {DAY.format('')}, true AS mae_ok FROM (SELECT CAST(ts AS DATE) AS date FROM events) d "
        "WHERE day(date) IN (22, 24, 26, 28, 30)"
    )
    q["gbt_validation"] = "SELECT CAST(unnest([1, 2, 3]) AS INT) AS trees, 'mae' AS metric, true AS value_ok"
    q["rf_validation"] = (
        "SELECT CAST(t AS INT) AS trees, m AS metric, true AS value_ok FROM range(1, 4) r(t), (SELECT unnest(['mae', 'rmse']) AS m)"
    )
    q["model_parameters"] = (
        "SELECT unnest(['numTrees', 'maxDepth', 'seed']) AS name, unnest(['2', '3', '1']) AS value"
    )
    hourly = ", ".join(f"round({t} / {d}, 6) AS {t}" for t, d in zip(LV, ("2000.0", "1000.0", "400.0", "200.0"), strict=True))
    q["rf_traffic_levels"] = _with(
        ["days", "traffic_rows"],
        f"""
, hourly AS MATERIALIZED (
  SELECT date, CAST(hour(ts) + 1 AS INT) AS slot, zone, t1, t2, t3, t4 FROM traffic_rows
  QUALIFY row_number() OVER (PARTITION BY date, hour(ts), zone ORDER BY ts DESC, event_id DESC) = 1)
SELECT {DAY.format('g.')}, g.zone AS district, g.slot AS timeslice, {hourly}, true AS in_range
FROM (SELECT date, CAST(zone AS INT) AS zone, CAST(slot AS INT) AS slot
      FROM days, (SELECT unnest(range(1, 67)) AS zone) z, (SELECT unnest(range(1, 25)) AS slot) s
      WHERE day(date) IN (22, 24, 26, 28, 30)) g
LEFT JOIN hourly h ON g.date = h.date AND g.slot = h.slot AND g.zone = h.zone""",
    )

    # round trips through files
    q["roundtrip_orders"] = _with(
        ["ride_orders"],
        "SELECT order_id, driver_id, passenger_id, start_hash, dest_hash, price, "
        "CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS sec "
        "FROM ride_orders",
    )
    q["roundtrip_traffic"] = _with(
        ["traffic_raw"],
        "SELECT zone_hash, level1, level2, level3, level4, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, "
        f"{SLOT} AS slot FROM traffic_raw",
    )
    q["roundtrip_weather"] = _with(
        ["weather_raw"],
        f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {SLOT} AS slot, weather, "
        "round(temperature, 6) AS temperature, round(pollution, 6) AS pollution FROM weather_raw",
    )
    q["roundtrip_zones"] = _with(["zones"], "SELECT zone_hash, zone_id FROM zones")
    q["clean_files"] = _with(
        ["gaps", "traffic_last", "weather_last"],
        f"""
SELECT 'gaps' AS source, {DAY.format('')}, count(*) AS n,
       CAST(sum(gap * (slot * 100 + origin + dest)) AS BIGINT) AS total FROM gaps GROUP BY date
UNION ALL SELECT 'traffic', CAST(date AS VARCHAR), count(*), CAST(sum((t1 + t4) * (slot * 100 + zone)) AS BIGINT)
FROM traffic_last GROUP BY date
UNION ALL SELECT 'weather', CAST(date AS VARCHAR), count(*), CAST(sum(weather * slot) AS BIGINT)
FROM weather_last GROUP BY date
UNION ALL SELECT unnest(['orders', 'traffic', 'weather']), 'all', count(*), 0::BIGINT FROM events""",
    )
    q["roundtrip_poi"] = _with(
        ["poi_tokens_raw"], "SELECT zone_hash, token FROM poi_tokens_raw"
    )
    q["roundtrip_weather_grid"] = q["weather_grid"]
    q["roundtrip_traffic_features"] = q["traffic_observed"]
    q["roundtrip_scored_traffic"] = _with(
        ["scored_traffic"],
        f"SELECT {DAY.format('')}, zone AS district, slot AS timeslice, "
        + ", ".join(f"round({t}, 6) AS {t}, round({t}p, 6) AS {t}p" for t in LV)
        + " FROM scored_traffic",
    )
    q["roundtrip_forecast"] = _with(
        ["rollup"],
        "SELECT '2024-01-' || lpad(CAST(day AS VARCHAR), 2, '0') AS date, slot AS timeslice, "
        'zone AS "districtID", gap, round(predict, 6) AS predict FROM rollup',
    )
    q["roundtrip_merged"] = _with(
        ["rollup"],
        "SELECT '2024-01-' || lpad(CAST(day AS VARCHAR), 2, '0') || '_' || CAST(slot AS VARCHAR) AS timeslice, "
        'zone AS "districtID", gap, round(predict, 6) AS predict FROM rollup',
    )
    q["roundtrip_features"] = q["features_norm"]
    return q
