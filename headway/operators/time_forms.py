"""Mixed timestamp formats and zones, brought to one unambiguous form.

Each source is a mixture of formats: the written forms, of which all-numeric dates are
two, day first and month first. Every value contributes its likelihood under each
format by which it is a real day or time; expectation-maximisation learns the formats'
weights per source, and the posterior chooses. A declared order is a prior worth
`DECLARED` values, which more evidence than that overrules. Values enter as counts per
source and set of valid formats, a bounded number of rows a source, so a source of any
size is one small group. Readings whose posterior stays below the threshold are marked
`ambiguous`.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import timeparse as tp
from headway.functions.text import strip_to_null
from headway.sources.tables import checkpointed

ORDERS = ("DMY", "MDY")
#: Pseudo-counts of a declared order, and of every format.
DECLARED, UNDECLARED = 1000.0, 1.0
THRESHOLD = 0.9
ROUNDS = 50


def _mixture(groups: pd.DataFrame) -> dict[str, float]:
    """EM for one source: the weights of its formats, from counts per set of valid ones."""
    cases = [(tuple(f), int(n)) for f, n in zip(groups["formats"], groups["n"], strict=True) if len(f)]
    declared = groups["declared"].dropna()
    prior = {f: UNDECLARED for f in {*ORDERS, *(f for formats, _ in cases for f in formats)}}
    for order in declared[:1]:
        prior[order] += DECLARED
    weight = {f: p / sum(prior.values()) for f, p in prior.items()}
    for _ in range(ROUNDS):
        mass = dict(prior)
        for formats, n in cases:
            total = sum(weight[f] for f in formats)
            for f in formats:
                mass[f] += n * weight[f] / total
        total = sum(mass.values())
        weight = {f: m / total for f, m in mass.items()}
    return weight


def valid_formats(p: Column) -> Column:
    """The formats by which a parsed value is a real day or time: its form, or the orders of an all-numeric date."""
    day = {o: tp.local_date(p, F.lit(o)) for o in ORDERS}
    # A date that both orders read alike, such as 5/5, says nothing about them.
    orders = F.when(p["a"] == p["b"], F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(d.isNotNull(), F.lit(o)) for o, d in day.items()])))
    dated = F.when(day["DMY"].isNotNull() | p["kind"].isin("clock", "epoch"), F.array(F.concat(F.lit("form "), p["form"].cast("string"))))
    return F.coalesce(F.when(p["kind"] == "numeric", orders).otherwise(dated), F.array().cast("array<string>"))


def learn_formats(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, zone, date_order, posterior, abbreviations), a row per source.

    `values` has source and parsed (of `timeparse.with_parts`), `sources` source, zone and
    declared (`DMY`, `MDY` or NULL), a row per source. The posterior is that of the
    likelier order for a date that both orders allow.
    """
    # No filters here: one on a parsed value would be pushed down and parse a second time.
    counts = values.select("source", valid_formats(F.col("parsed")).alias("formats")).groupBy("source", "formats").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    known = sources.select("source", F.array().cast("array<string>").alias("formats"), F.lit(0).cast("bigint").alias("n"), "declared", "zone")
    rows = counts.select("source", "formats", "n", none.alias("declared"), none.alias("zone")).unionByName(known)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        weight = _mixture(group)
        best = max(ORDERS, key=weight.__getitem__)
        zones = group["zone"].dropna()
        zone = zones.iloc[0] if len(zones) else None
        posterior = weight[best] / sum(weight[o] for o in ORDERS)
        return pd.DataFrame({"source": [group["source"].iloc[0]], "zone": [zone], "date_order": [best], "posterior": [posterior], "abbreviations": [tp.zone_abbreviations(zone)]})

    return rows.groupBy("source").applyInPandas(fit, "source string, zone string, date_order string, posterior double, abbreviations map<string, int>")


def resolve(df: DataFrame, day: str | None = None) -> DataFrame:
    """Adds `_date`, `_wall`, `_seconds` (since 1970), `_state` to rows with parsed, zone, date_order, posterior and abbreviations.

    `_state` is `ambiguous`, `nonexistent` or NULL. `day` names the date column that
    elapsed times count from. An unknown zone name leaves both NULL. The steps are
    projections of their own so that each is computed once.
    """
    known = sorted(z for z in available_timezones() if "/" in z)
    p = F.col("parsed")
    learnt = F.coalesce(F.col("date_order"), F.lit(ORDERS[0]))
    other = F.when(learnt == "DMY", "MDY").otherwise("DMY")
    df = df.withColumns({"_d1": tp.local_date(p, learnt), "_d2": F.when(p["kind"] == "numeric", tp.local_date(p, other))})
    sure = F.col("_d1").isNull() | F.col("_d2").isNull() | (F.col("_d1") == F.col("_d2")) | (F.col("posterior") >= THRESHOLD)
    df = df.withColumns({"_date": F.coalesce("_d1", "_d2"), "_sure": F.coalesce(sure, F.lit(False)), "_offset": tp.offset_seconds(p["zone"], F.col("abbreviations")), "_named": tp.named_zone("parsed.zone", known)})
    after = p["h"] * 3600 + p["mi"] * 60 + p["s"]
    midnight = F.when(p["kind"] == "clock", tp.epoch_of(tp.to_utc(F.col(day).cast("timestamp_ntz"), F.col("zone")))) if day else F.lit(None).cast("bigint")
    df = df.withColumns({
        "_wall": F.timestamp_add("SECOND", after, F.col("_date").cast("timestamp_ntz")),
        "_at": F.when(p["zone"].isNull(), F.col("zone")).otherwise(F.col("_named")),
        "_clock": midnight + after,
    })
    floating = (p["kind"] != "clock") & p["epoch"].isNull() & F.col("_offset").isNull()
    df = df.withColumn("_utc", F.when(floating, tp.to_utc(F.col("_wall"), F.col("_at"))))
    df = df.withColumn("_state", F.when(~F.col("_sure"), "ambiguous").when(floating, tp.zone_state(F.col("_wall"), F.col("_utc"), F.col("_at"))))
    seconds = F.coalesce(p["epoch"], F.col("_clock"), tp.epoch_of(F.col("_wall")) - F.col("_offset"), tp.epoch_of(F.col("_utc")))
    return df.withColumn("_seconds", F.when(F.col("_state").isNull(), seconds)).drop("_d1", "_d2", "_sure", "_offset", "_named", "_at", "_clock", "_utc")


def with_orders(rows: DataFrame, sources: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """`rows` (source, parsed, …) with zone, abbreviations, and for all-numeric dates the learnt order and its posterior.

    `values`, if given, are learnt from instead: all rows whose form isn't settled suffice
    for the orders.
    """
    facts = learn_formats(rows if values is None else values, sources)
    return rows.join(facts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def normalise_times(rows: DataFrame, sources: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, epoch, norm_value, posterior) of each value that states a time.

    `rows` has source, value, day (the date elapsed times count from) and the columns
    of `keep`; `sources` has source, zone and declared order. norm_value is the UTC
    instant, `ambiguous` or `nonexistent`. Values that state no time (blank, words,
    minutes or seconds above 59) give no row; where the zone is unknown and needed,
    norm_value is `unresolved`. Values are parsed once and written, for what is learnt
    from them and what comes of it.
    """
    stated = rows.where(tp.tokens(F.col("value"), True).isNotNull())
    parsed = checkpointed(tp.with_parts(stated, F.col("value"), True).select("source", "day", *keep, "parsed"))
    out = resolve(with_orders(parsed, sources), "day").select(*keep, F.col("_seconds").alias("epoch"), "_state", "posterior")
    text = F.date_format(tp.wall_of(F.col("epoch")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select(*keep, "epoch", F.coalesce("_state", text, F.lit("unresolved")).alias("norm_value"), "posterior")


def normalise_dates(rows: DataFrame, sources: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, norm_value, posterior): each value that names a day, as `yyyy-MM-dd` in the source's zone.

    A wall clock without zone names its own day; an instant is brought to the source's
    zone. Blank values and words give no row; a day that isn't in the calendar, such as
    30 February, is `nonexistent`.
    """
    stated = rows.where(tp.tokens(F.col("value"), False).isNotNull())
    parsed = checkpointed(tp.with_parts(stated, F.col("value"), False).select("source", *keep, "parsed"))
    p = F.col("parsed")
    zoned = (p["kind"] == "epoch") | (p["zone"].isNotNull() & p["h"].isNotNull())
    local = F.to_date(tp.to_local(tp.wall_of(F.col("_seconds")), F.col("zone")))
    day = F.date_format(F.when(zoned, local).otherwise(F.col("_date")), "yyyy-MM-dd")
    norm = F.when(zoned | (F.col("_state") == "ambiguous") & (p["h"].isNull()), F.coalesce("_state", day)).otherwise(day)
    norm = F.coalesce(norm, F.when(F.col("_date").isNull() & (p["kind"] != "epoch"), "nonexistent").otherwise("unresolved"))
    return resolve(with_orders(parsed, sources)).select(*keep, norm.alias("norm_value"), "posterior")


def agency_sources(agency: DataFrame) -> DataFrame:
    """(source, zone, declared), a row per agency; repeated agencies keep the least values."""
    known = sorted(available_timezones())
    zone = strip_to_null("agency_timezone")
    return agency.where(F.col("agency_id").isNotNull()).groupBy(F.col("agency_id").alias("source")).agg(
        F.min(F.when(zone.isin(known), zone)).alias("zone"), F.min(F.when(F.col("date_order").isin(*ORDERS), F.col("date_order"))).alias("declared")
    )
