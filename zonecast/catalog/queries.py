"""One query per operator, over the whole driver tables.

Keys that are dates come out as text, doubles are rounded, so that two engines
can be compared.  The dense tables (19 million rows for 30 days) come out as a
digest: sums per (date, district) over every row and column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEVELS, POI_COLUMNS, TEST_DAYS, TRAIN_DAYS, month_dates
from ..fixtures import Inputs
from ..functions import scalars as sc
from ..operators import dims, fill, forecasts, gaps, grids, poi, quality, scale, series, split
from ..operators.prepare import impute_mean, index_categories
from ..plans import features as pf
from ..plans.clean import RawPaths, clean
from ..session import new_path, ship_package
from ..sources import readers, schemas, writers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    REGISTRY[fn.__name__] = partial(_run, fn)
    return fn


def _run(fn: Callable[[Inputs], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return fn(Inputs(spark, sf_dir))


def _text_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def _rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


# -- scalars ------------------------------------------------------------------


@query
def slot_of_day(i: Inputs) -> DataFrame:
    return i.table("events").select("event_id", sc.slot_of_day("ts").alias("slot"))


@query
def day_mod7(i: Inputs) -> DataFrame:
    return i.table("events").select("event_id", sc.day_mod7("ts").alias("day"))


@query
def day_label(i: Inputs) -> DataFrame:
    return i.table("events").select("event_id", sc.day_label(F.dayofmonth("ts")).alias("label"))


@query
def od_encode(i: Inputs) -> DataFrame:
    return i.view("scored_cells").select(
        "day", "slot", "zone", "dest", sc.od_encode("slot", "zone", "dest").alias("id")
    )


@query
def od_decode(i: Inputs) -> DataFrame:
    ids = i.view("scored_cells").select(sc.od_encode("slot", "zone", "dest").alias("id"))
    return ids.withColumn("k", sc.od_decode("id")).select("id", "k.*")


@query
def zone_slot_key(i: Inputs) -> DataFrame:
    return i.view("scored_cells").select("slot", "zone", sc.zone_slot_key("slot", "zone").alias("k"))


@query
def level_parse(i: Inputs) -> DataFrame:
    levels = [sc.parse_level(f"level{k}").alias(f"t{k}") for k in (1, 2, 3, 4)]
    return i.view("traffic_raw").select("event_id", *levels)


@query
def slot_label(i: Inputs) -> DataFrame:
    date = F.to_date("ts")
    name = F.concat(F.lit("final_day_"), date.cast("string"), F.lit("_test.csv"))
    return i.table("events").select(
        "event_id",
        sc.slot_label(date, sc.slot_of_day("ts")).alias("label"),
        sc.label_from_name(name).alias("from_name"),
    )


@query
def temp_clamp(i: Inputs) -> DataFrame:
    return _rounded(
        i.view("weather_raw").select("event_id", sc.clamp_temp("temperature").alias("temp")), ["temp"]
    )


@query
def weather_scale(i: Inputs) -> DataFrame:
    return _rounded(_text_date(scale.scale_weather(i.weather)), ["temp", "pollution"])


@query
def traffic_scale(i: Inputs) -> DataFrame:
    return _text_date(scale.scale_traffic(i.traffic))


def _scored_traffic(i: Inputs) -> DataFrame:
    """Observed levels, NULL where there are none, beside stand-in predictions."""
    cells = pf.join_traffic(grids.zone_grid(i.days), scale.scale_traffic(i.traffic))
    slot, zone = F.col("slot"), F.col("zone")
    return cells.select(
        "date", "slot", "zone", *LEVELS,
        (slot / 100.0 + zone / 10.0).alias("t1p"),
        (slot / 50.0).alias("t2p"),
        (zone / 20.0).alias("t3p"),
        (slot % 7 + zone / 8.0).alias("t4p"),
    )


@query
def observed_or_predicted(i: Inputs) -> DataFrame:
    levels = [F.round(sc.observed_or(t, t + "p"), 6).alias(t) for t in LEVELS]
    return _text_date(_scored_traffic(i).select("date", "slot", "zone", *levels))


@query
def pred_threshold(i: Inputs) -> DataFrame:
    return i.view("scored_cells").withColumn("predict", sc.cut_small("predict"))


@query
def abs_error(i: Inputs) -> DataFrame:
    err = F.round(sc.abs_error("predict", "gap"), 6).alias("err")
    return i.view("scored_cells").select("day", "slot", "zone", "dest", err)


# -- quality ------------------------------------------------------------------


@query
def drop_all_null(i: Inputs) -> DataFrame:
    holes = i.table("events").select(
        F.when(F.col("event_id") % 6 != 0, F.col("event_id")).alias("id"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"),
    )
    return quality.drop_all_null(holes)


@query
def invalid_slots(i: Inputs) -> DataFrame:
    """A calendar of 100 slots, which the later slots of a day lie outside of."""
    return quality.audit_slots(i.table("events"), sc.slot_of_day("ts"), 100)


@query
def unserved_orders(i: Inputs) -> DataFrame:
    return i.orders.where(sc.is_unserved("driver_id")).select("event_id")


@query
def unknown_zone_rejects(i: Inputs) -> DataFrame:
    _, rejects = dims.split_known(i.orders, i.zones, "dest_hash")
    return rejects.select("event_id", "dest_hash")


@query
def stage_counts(i: Inputs) -> DataFrame:
    return quality.count_stages(
        orders=i.orders,
        unserved=i.orders.where(sc.is_unserved("driver_id")),
        gap_cells=i.gaps,
        traffic=i.view("traffic_raw"),
        traffic_cells=i.traffic,
        traffic_filled=fill.fill_traffic(i.days, i.traffic),
        weather=i.view("weather_raw"),
    )


@query
def observed_count(i: Inputs) -> DataFrame:
    """The count comes from observing another action (here: a write that keeps nothing)."""
    unserved = i.orders.where(sc.is_unserved("driver_id"))
    df, obs = quality.observed(unserved, "unserved")
    df.write.format("noop").mode("overwrite").save()
    return i.spark.createDataFrame([(obs.get["n_rows"],)], "n_rows bigint")


@query
def const_columns(i: Inputs) -> DataFrame:
    df = i.table("events").select(
        "event_id", "value", F.lit(4).alias("n_levels"), F.lit(None).cast("int").alias("nothing")
    )
    return quality.constant_columns(df, df.columns)


# -- dimensions and joins -----------------------------------------------------


@query
def zone_map(i: Inputs) -> DataFrame:
    """Of the many rows of a hash the last one counts."""
    return dims.zone_map(i.view("zone_log"), "pos")


@query
def zone_dim_usage(i: Inputs) -> DataFrame:
    """Events per zone of the built-in dimension."""
    per_zone = i.table("events").groupBy((F.col("user_id") % 66 + 1).cast("int").alias("zone_id"))
    return F.broadcast(readers.zone_dim(i.spark)).join(
        per_zone.agg(F.count(F.lit(1)).alias("n")), "zone_id"
    )


@query
def zone_lookup(i: Inputs) -> DataFrame:
    """Origins must be known; unknown destinations become 0."""
    known = dims.attach_zone(
        i.orders.select("event_id", "start_hash", "dest_hash"), i.zones, "start_hash", "origin", strict=False
    )
    return dims.attach_zone(known, i.zones, "dest_hash", "dest", default=0)


@query
def day_select(i: Inputs) -> DataFrame:
    dated = i.orders.select("event_id", F.to_date("ts").alias("date"))
    return _text_date(readers.select_days(dated, TEST_DAYS))


# -- aggregations -------------------------------------------------------------


@query
def gap_counts(i: Inputs) -> DataFrame:
    return _text_date(i.gaps)


@query
def served_total(i: Inputs) -> DataFrame:
    return _text_date(gaps.served_total(i.orders))


@query
def traffic_last(i: Inputs) -> DataFrame:
    return _text_date(i.traffic)


@query
def weather_last(i: Inputs) -> DataFrame:
    return _rounded(_text_date(i.weather), ["temp", "pollution"])


@query
def poi_last(i: Inputs) -> DataFrame:
    """Each part as one input row of its zone: the last row replaces the earlier ones."""
    rows = i.view("poi_tokens_raw").withColumn("row_pos", F.col("pos"))
    return poi.last_rows(rows).select("zone_hash", "pos", "token")


@query
def poi_tokens(i: Inputs) -> DataFrame:
    return i.poi.select("zone", "cat", "sub", "n")


@query
def poi_rollup(i: Inputs) -> DataFrame:
    return poi.poi_rollup(i.poi)


@query
def poi_rollup_scaled(i: Inputs) -> DataFrame:
    return _rounded(poi.poi_rollup(i.poi, scaled=True), ["n"], 9)


@query
def poi_pivot(i: Inputs) -> DataFrame:
    return _rounded(poi.poi_pivot(i.poi), POI_COLUMNS, 9)


@query
def key_frequency(i: Inputs) -> DataFrame:
    return gaps.key_frequency(gaps.keyed_orders(i.orders, i.zones), "origin")


# -- grids and fills ----------------------------------------------------------


@query
def od_grid_gap(i: Inputs) -> DataFrame:
    cells = gaps.join_gap(grids.od_grid(i.days), i.gaps)
    weight = F.col("slot") * 100 + F.col("dest")
    return _text_date(
        cells.groupBy("date", "origin").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("gap").alias("gap"),
            F.sum(F.col("gap") * weight).alias("check_sum"),
        )
    )


@query
def weather_grid(i: Inputs) -> DataFrame:
    return _rounded(_text_date(pf.weather_table(i.days, i.weather)), ["temp", "pollution"])


@query
def weather_fill(i: Inputs) -> DataFrame:
    filled = fill.fill_weather(i.days, scale.scale_weather(i.weather))
    return _rounded(_text_date(filled), ["temp", "pollution"])


@query
def traffic_fill(i: Inputs) -> DataFrame:
    return _text_date(fill.fill_traffic(i.days, i.traffic))


@query
def traffic_fill_flat(i: Inputs) -> DataFrame:
    return _text_date(fill.fill_traffic(i.days, i.traffic, leak_carry=False))


@query
def traffic_fill_stale(i: Inputs) -> DataFrame:
    return _text_date(fill.fill_traffic(i.days, i.traffic, stale_keys=True))


# -- feature tables -----------------------------------------------------------


def _micro_sums(cols: list[str]) -> list[Column]:
    """Sums in whole millionths: exact, whatever the order of the rows."""
    return [
        F.sum(F.rint(F.col(f"`{c}`").cast("double") * 1e6).cast("bigint")).alias(f"s_{c}")
        for c in cols
    ]


def _slot_sums(cols: list[str]) -> list[Column]:
    """The same with the slot as weight: a value on the wrong slot shows."""
    return [
        F.sum(F.rint(F.col(c).cast("double") * 1e6).cast("bigint") * F.col("timeslice")).alias(f"p_{c}")
        for c in cols
    ]


def _gap_digest(m: DataFrame) -> DataFrame:
    measures = ["traffic1", "traffic2", "traffic3", "traffic4", "temp", "pollution", *POI_COLUMNS]
    gap = F.col("gap")
    return _text_date(
        m.groupBy("date", "districtID").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("id").alias("s_id"),
            F.min("day").alias("day"),
            F.sum(gap).alias("s_gap"),
            F.sum(gap * F.col("id")).alias("s_gap_id"),
            F.sum(gap * F.col("destDistrict")).alias("s_gap_dest"),
            F.sum(F.col("weather") * F.col("timeslice")).cast("bigint").alias("s_weather"),
            F.count("traffic1").alias("n_traffic"),
            *_micro_sums(measures),
            *_slot_sums(measures[:6]),
        )
    )


def norm_matrix(i: Inputs) -> DataFrame:
    return pf.features_norm(i.days, i.gaps, i.traffic, i.weather, poi.poi_pivot(i.poi), i.cfg)


@query
def features_raw(i: Inputs) -> DataFrame:
    pivot = poi.poi_pivot(i.poi, scaled=False)
    return _gap_digest(pf.features_raw(i.days, i.gaps, i.traffic, i.weather, pivot))


@query
def features_norm(i: Inputs) -> DataFrame:
    return _gap_digest(norm_matrix(i))


@query
def features_test(i: Inputs) -> DataFrame:
    return _gap_digest(
        pf.features_test(i.days, i.gaps, _scored_traffic(i), i.weather, poi.poi_pivot(i.poi))
    )


def _observed(i: Inputs) -> DataFrame:
    return pf.traffic_observed(i.days, i.traffic, i.weather, poi.poi_pivot(i.poi))


def _show_traffic(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(_text_date(df), [*LEVELS, "temp", "pollution"]), POI_COLUMNS, 9)


@query
def traffic_train(i: Inputs) -> DataFrame:
    return _show_traffic(pf.traffic_train(i.days, i.traffic, i.weather, poi.poi_pivot(i.poi)))


@query
def traffic_train_stale(i: Inputs) -> DataFrame:
    return _show_traffic(
        pf.traffic_train(i.days, i.traffic, i.weather, poi.poi_pivot(i.poi), stale_keys=True)
    )


@query
def traffic_observed(i: Inputs) -> DataFrame:
    return _show_traffic(_observed(i))


@query
def traffic_predict_grid(i: Inputs) -> DataFrame:
    return _show_traffic(
        pf.traffic_predict_grid(i.days, i.traffic, i.weather, poi.poi_pivot(i.poi))
    )


# -- splits and preparation ---------------------------------------------------


@query
def category_index(i: Inputs) -> DataFrame:
    cells = i.view("scored_cells").groupBy("slot", "zone").agg(F.count(F.lit(1)).alias("n"))
    indexer = index_categories(["slot", "zone"], ["slot_ix", "zone_ix"])
    return indexer.fit(cells).transform(cells)


@query
def hash_split(i: Inputs) -> DataFrame:
    return i.table("events").select(
        "event_id", split.in_train("event_id", "ts").alias("train")
    )


@query
def temporal_split(i: Inputs) -> DataFrame:
    dated = i.table("events").select("event_id", F.to_date("ts").alias("date"))
    train, test = split.day_split(dated, TRAIN_DAYS, TEST_DAYS)
    return forecasts.union_days(
        [
            train.select("event_id", F.lit("train").alias("part")),
            test.select("event_id", F.lit("test").alias("part")),
        ]
    )


@query
def gap_split(i: Inputs) -> DataFrame:
    """The 80/20 split on the ids of the gap cells: rows that train per (date, slot), and a checksum of them."""
    cells = i.gaps.select("date", "slot", sc.od_encode("slot", "origin", "dest").alias("id"))
    train, held_out = split.hash_split(cells, "id")
    named = [df.withColumn("part", F.lit(n)) for df, n in ((train, "train"), (held_out, "held out"))]
    both = forecasts.union_days(named).groupBy("date", "slot", "part")
    return _text_date(both.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s_id")))


@query
def random_split(i: Inputs) -> DataFrame:
    """No row in both parts, none lost, and four fifths of them (within five hundredths) in the first."""
    first, second = split.random_split(i.table("events").select("event_id"))
    both = forecasts.union_days([first.withColumn("first", F.lit(1)), second.withColumn("first", F.lit(0))])
    per_row = both.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"), F.max("first").alias("first"))
    return per_row.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("times") > 1).alias("n_twice"),
        F.avg("first").between(0.75, 0.85).alias("share_ok"),
    )


@query
def mean_impute(i: Inputs) -> DataFrame:
    grid = fill.weather_grid(i.days, i.weather).select("date", "slot", "temp", "pollution")
    return _rounded(_text_date(impute_mean(grid, ["temp", "pollution"])), ["temp", "pollution"])


# -- forecasts ----------------------------------------------------------------

CELL = ["day", "slot", "zone"]


def _rollup(i: Inputs, cut: float | None) -> DataFrame:
    return forecasts.forecast_rollup(i.view("scored_cells"), cut, CELL)


@query
def forecast_rollup(i: Inputs) -> DataFrame:
    return _rounded(_rollup(i, 0.5), ["predict"])


@query
def forecast_rollup_plain(i: Inputs) -> DataFrame:
    return _rounded(_rollup(i, None), ["predict"])


@query
def forecast_mae(i: Inputs) -> DataFrame:
    return _rounded(forecasts.mean_abs_error(_rollup(i, None), "day"), ["mae"])


@query
def forecast_first20(i: Inputs) -> DataFrame:
    return _rounded(forecasts.first_rows(_rollup(i, 0.5), 20, CELL), ["predict"])


@query
def union_days(i: Inputs) -> DataFrame:
    train, rest = split.day_split(i.gaps, TRAIN_DAYS, month_dates(range(22, 32)))
    return _text_date(forecasts.union_days([train, rest]))


def _dated_rollup(i: Inputs) -> DataFrame:
    date = F.concat(F.lit("2024-01-"), sc.day_label("day")).cast("date")
    return (
        _rounded(_rollup(i, 0.5), ["predict"])
        .withColumn("date", date)
        .withColumnsRenamed({"slot": "timeslice", "zone": "districtID"})
    )


@query
def merge_outputs(i: Inputs) -> DataFrame:
    return forecasts.merge_forecasts(readers.select_days(_dated_rollup(i), TEST_DAYS))


# -- series -------------------------------------------------------------------


@query
def lag_matrix(i: Inputs) -> DataFrame:
    return series.lag_matrix(i.view("daily_series"), "key", "t", ["x", "y"], 2)


@query
def padded_len(i: Inputs) -> DataFrame:
    lengths = i.view("daily_series").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return lengths.withColumn("padded", series.padded_len("n"))


@query
def spectrum(i: Inputs) -> DataFrame:
    return _rounded(series.spectrum(i.view("daily_series"), "key", "t", "y"), ["mag"])


@query
def power_spectrum(i: Inputs) -> DataFrame:
    psd = series.power_spectrum(i.view("daily_series"), "key", "t", "y")
    return _rounded(_rounded(psd, ["mag"]), ["psd"], 5)


@query
def tss(i: Inputs) -> DataFrame:
    return _rounded(series.tss(i.view("daily_series"), "key", "y"), ["tss"], 4)


def _lag1_fit(i: Inputs) -> tuple[DataFrame, DataFrame]:
    lagged = series.lag_matrix(i.view("daily_series"), "key", "t", ["y"], 1)
    return lagged, series.ols_by_key(lagged, "key", "y", ["y_lag1"])


@query
def ols_lag1(i: Inputs) -> DataFrame:
    _, fit = _lag1_fit(i)
    cols = ["intercept", "slope", "r2"]
    return _rounded(
        fit.withColumn("slope", F.element_at("coef", 1)).select("key", "n", *cols), cols
    )


@query
def rss(i: Inputs) -> DataFrame:
    lagged, fit = _lag1_fit(i)
    resid = F.expr("y - intercept - coef[0] * y_lag1")
    joined = lagged.join(fit.select("key", "intercept", "coef"), "key").withColumn("resid", resid)
    return _rounded(series.rss(joined, "key", "resid"), ["rss"], 4)


def _granger(i: Inputs, lag: int) -> DataFrame:
    return series.granger(i.view("daily_series"), "key", "t", "x", "y", lag)


@query
def granger_l1(i: Inputs) -> DataFrame:
    return _rounded(_granger(i, 1).drop("p"), ["f", "r2"])


@query
def granger_l2(i: Inputs) -> DataFrame:
    return _rounded(_granger(i, 2).drop("p"), ["f", "r2"])


@query
def granger_p(i: Inputs) -> DataFrame:
    return _rounded(_granger(i, 2), ["f", "r2", "p"])


# -- round trips through files ------------------------------------------------


def _write_tsv(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    (
        df.write.option("sep", "\t")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )
    return path


@query
def roundtrip_orders(i: Inputs) -> DataFrame:
    cols = ["order_id", "driver_id", "passenger_id", "start_hash", "dest_hash", "price"]
    back = readers.read_orders(i.spark, _write_tsv(i.orders.select(*cols, "ts"), "orders"))
    date = F.to_date("ts").cast("string").alias("date")
    return back.select(*cols, date, sc.seconds_of_day("ts").alias("sec"))


@query
def roundtrip_traffic(i: Inputs) -> DataFrame:
    cols = ["zone_hash", "level1", "level2", "level3", "level4"]
    path = _write_tsv(i.view("traffic_raw").select(*cols, "ts"), "traffic")
    date = F.to_date("ts").cast("string").alias("date")
    return readers.read_traffic(i.spark, path).select(*cols, date, sc.slot_of_day("ts").alias("slot"))


@query
def roundtrip_weather(i: Inputs) -> DataFrame:
    cols = ["weather", "temperature", "pollution"]
    path = _write_tsv(i.view("weather_raw").select("ts", *cols), "weather")
    date = F.to_date("ts").cast("string").alias("date")
    back = readers.read_weather(i.spark, path).select(date, sc.slot_of_day("ts").alias("slot"), *cols)
    return _rounded(back, ["temperature", "pollution"])


@query
def roundtrip_zones(i: Inputs) -> DataFrame:
    padded = i.view("zones").select("zone_hash", F.concat(F.col("zone_id").cast("string"), F.lit(" ")))
    return readers.read_zones(i.spark, _write_tsv(padded, "zones")).drop("row_pos")


def _day_files(df: DataFrame, name: str) -> str:
    """Tab-separated files by day, in the order of their rows."""
    path = new_path(df.sparkSession, name)
    dated = df.withColumn("date", F.to_date("ts")).repartition("date").sortWithinPartitions("date", "ts")
    (
        dated.write.partitionBy("date")
        .option("sep", "\t")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )
    return f"{path}/*"


@query
def clean_files(i: Inputs) -> DataFrame:
    """Day files written, read and cleaned: sums of every table per date, and the slot weights of their values."""
    order = ["order_id", "driver_id", "passenger_id", "start_hash", "dest_hash", "price", "ts"]
    log = i.view("zone_log").orderBy("pos").select("zone_hash", F.col("zone_id").cast("string")).coalesce(1)
    lines = i.view("poi_tokens_raw").select(F.concat_ws("\t", "zone_hash", "token").alias("value"))
    poi_path = new_path(i.spark, "poi")
    lines.write.text(poi_path)
    paths = RawPaths(
        _day_files(i.orders.select(*order), "orders"),
        _day_files(i.view("traffic_raw").select("zone_hash", "level1", "level2", "level3", "level4", "ts"), "traffic"),
        _day_files(i.view("weather_raw").select("ts", "weather", "temperature", "pollution"), "weather"),
        _write_tsv(log, "zones"),
        poi_path,
    )
    c, audit = clean(i.spark, paths)
    at = {"gaps": (c.gaps, "gap * (slot * 100 + origin + dest)"), "traffic": (c.traffic, "(t1 + t4) * (slot * 100 + zone)"),
          "weather": (c.weather, "weather * slot")}
    sums = [
        df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.expr(f"cast(sum({value}) as bigint)").alias("total"))
        .select(F.lit(name).alias("source"), F.col("date").cast("string").alias("date"), "n", "total")
        for name, (df, value) in at.items()
    ]
    read = audit.select("source", F.lit("all").alias("date"), F.col("n_rows").alias("n"), F.col("n_invalid").alias("total"))
    return forecasts.union_days([*sums, read])


@query
def roundtrip_poi(i: Inputs) -> DataFrame:
    """Ragged lines: every third has a blank token at its end."""
    tail = F.when(F.col("pos") % 3 == 0, "\t").otherwise("")
    lines = i.view("poi_tokens_raw").select(
        F.concat(F.col("zone_hash"), F.lit("\t"), F.col("token"), tail).alias("value")
    )
    path = new_path(i.spark, "poi")
    lines.write.text(path)
    tokens = poi.explode_tokens(readers.read_poi(i.spark, path))
    return tokens.where(~sc.is_blank("token")).select("zone_hash", "token")


@query
def roundtrip_weather_grid(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "weather_grid")
    writers.write_daily(pf.weather_table(i.days, i.weather), path, "csv")
    back = readers.read_weather_grid(i.spark, path, "csv")
    return _rounded(_text_date(back), ["temp", "pollution"])


@query
def roundtrip_traffic_features(i: Inputs) -> DataFrame:
    """Written in two halves, read back as one table."""
    early, late = split.day_split(_observed(i), TRAIN_DAYS, month_dates(range(22, 32)))
    paths = [new_path(i.spark, "traffic_features") for _ in range(2)]
    for part, path in zip((early, late), paths, strict=True):
        writers.write_daily(part, path, "csv")
    back = [readers.read_traffic_features(i.spark, p, "csv") for p in paths]
    return _show_traffic(forecasts.union_days(back))


@query
def roundtrip_scored_traffic(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "scored_traffic")
    named = _scored_traffic(i).withColumnsRenamed({"zone": "district", "slot": "timeslice"})
    writers.write_daily(named.select("date", *schemas.SCORED_TRAFFIC.names), path, "csv")
    cols = [c for t in LEVELS for c in (t, t + "p")]
    back = readers.read_scored_traffic(i.spark, path, "csv")
    return _rounded(_text_date(back), cols)


@query
def roundtrip_forecast(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "forecast")
    writers.write_forecast(_dated_rollup(i), path)
    return _rounded(_text_date(readers.read_forecast(i.spark, path)), ["predict"])


@query
def roundtrip_merged(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "merged")
    writers.write_merged(_dated_rollup(i), path)
    schema = "timeslice string, districtID int, gap bigint, predict double"
    return i.spark.read.schema(schema).option("header", True).csv(path)


@query
def roundtrip_features(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "features")
    writers.write_daily(norm_matrix(i), path)
    return _gap_digest(readers.read_features(i.spark, path))
