"""Mixed timestamp notations and time zones brought to one instant in UTC.

Every text is matched against the notations below. A notation gives one reading, a slashed date up to two (day first,
month first). Expectation-maximisation per source learns how often each reading is meant: a text adds likelihood to
each reading that is possible for it, and the posteriors choose the reading of texts with more than one. An instant's
posterior is that of all readings that give it; `instant_us` is set where it is 1, that is where no other instant is
possible. Other texts are marked `ambiguous`; `likely_us` has the choice of the posteriors and `likely_posterior` its
posterior for every text with a reading.

Status of a text: exact, ambiguous (readings differ), twice and never (local time in an autumn or spring change of the
clock), no_zone, no_time, not_a_date; null, empty and blank texts are not_a_date. Parts of a microsecond are cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, one_per_id, table

_D4, _D2, _D12 = r"(\d{4})", r"(\d\d)", r"(\d{1,2})"
_CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,12}))?)?"
_ZONE = r"(Z|[A-Z]{2,5}|[+-]\d\d:?\d\d|[+-]\d\d|[A-Z][A-Za-z_]+/[A-Za-z_/+-]+)?"


@dataclass(frozen=True)
class Notation:
    """roles has, for each group of the pattern, what it holds; a and b are day and month in unknown order."""

    name: str
    pattern: str
    roles: str


NOTATIONS = (
    Notation("pdf", r"^D:(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?(?:(Z)(?:\d\d'?(?:\d\d'?)?)?|([+-]\d\d'?(?:\d\d)?'?))?$", "y m d h i s z o"),
    Notation("iso", rf"^{_D4}-{_D2}-{_D2}(?:[T ]+{_CLOCK} ?{_ZONE}(?:\[([A-Za-z_/+-]+)\])?)?$", "y m d h i s f z r"),
    Notation("dotted", rf"^{_D12}\.{_D12}\.{_D4}(?:,? +{_CLOCK} ?{_ZONE})?$", "d m y h i s f z"),
    Notation("slashed", rf"^{_D12}/{_D12}/{_D4}(?:,? +{_CLOCK} ?([AaPp][Mm])? ?{_ZONE})?$", "a b y h i s f p z"),
    Notation("mail", rf"^(?:([A-Za-z]{{3}}), )?{_D12} ([A-Za-z]{{3,9}}) {_D4} {_CLOCK} ?{_ZONE}$", "w d n y h i s f z"),
    Notation("german", rf"^{_D12}\. ([A-Za-zäÄ]+) {_D4}, {_CLOCK} Uhr$", "d n y h i s f"),
    Notation("american", rf"^([A-Za-z]{{3,9}}) {_D12}, {_D4} {_CLOCK} ?([AaPp][Mm])? ?{_ZONE}$", "n d y h i s f p z"),
    Notation("openssl", rf"^([A-Za-z]{{3}}) +{_D12} {_CLOCK} {_D4} ([A-Z]{{3,4}})$", "n d h i s f y z"),
    Notation("asn1_long", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(?:[.,](\d{1,12}))?(Z|[+-]\d{4})$", "y m d h i s f z"),
    Notation("asn1_short", r"^(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?(Z|[+-]\d{4})$", "v m d h i s z"),
    Notation("epoch_s", r"^(\d{9,10})$", "e"),
    Notation("epoch_ms", r"^(\d{12,13})$", "E"),
)

#: Month names and the abbreviations of zones that mean one offset (minutes).
MONTHS = {
    **{m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)},
    **{m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    **{m: i for i, m in enumerate("januar februar märz april mai juni juli august september oktober november dezember".split(), 1)},
    "sept": 9,
}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540,
    "AEST": 600, "AEDT": 660, "NST": -210, "NDT": -150, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_DAY, _MINUTE = 86_400_000_000, 60_000_000


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _parts(kind: Column, text: Column) -> Column:
    """All groups of the matching notation at once, parted by a control character that no notation allows."""
    chain = None
    for n in NOTATIONS:
        marked = "\x01".join(f"${i}" for i in range(1, len(n.roles.split()) + 1))
        got = F.split(F.regexp_replace(text, n.pattern, marked), "\x01", -1)
        chain = F.when(kind == n.name, got) if chain is None else chain.when(kind == n.name, got)
    return chain


def _part(kind: Column, parts: Column, role: str) -> Column:
    """What the matching notation holds for the role, null if nothing."""
    chain = None
    for n in NOTATIONS:
        roles = n.roles.split()
        if role in roles:
            at = roles.index(role)
            chain = F.when(kind == n.name, at) if chain is None else chain.when(kind == n.name, at)
    return F.nullif(F.get(parts, chain), F.lit(""))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, null if there is no such date."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    yy = F.when(m <= 2, y - 1).otherwise(y)
    doy = F.floor((F.lit(153) * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5) + d - 1
    days = yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + doy - 719468
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), days.cast("bigint"))


def _offset(zone: Column, at: Column) -> Column:
    """Microseconds by which the zone's clock is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone)) - at


def known_zones(spark: SparkSession) -> list[str]:
    """Names of regions that Spark's own zone data has."""
    return sorted(z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)


def _resolve(df: DataFrame, local: str, out: str, zones: list[str]) -> DataFrame:
    """Adds `out`: the instant of the local time, and `out`_how: exact, twice, never or no_zone."""
    region = F.when(F.col("_region").isin(zones), F.col("_region"))
    t = F.col(local)
    # the clock's offsets well before and well after the time; an instant counts if the clock showed the time at it
    df = df.withColumn("_one", t - _offset(region, t - F.lit(_DAY))).withColumn("_two", t - _offset(region, t + F.lit(_DAY)))
    shown = lambda c: F.col(c) + _offset(region, F.col(c)) == t
    df = df.withColumn("_n1", shown("_one")).withColumn("_n2", shown("_two"))
    fixed = F.col("_minutes")
    how = (
        F.when(t.isNull(), None)
        .when(fixed.isNotNull(), "exact")
        .when(region.isNull(), "no_zone")
        .when(F.col("_n1") & F.col("_n2") & (F.col("_one") != F.col("_two")), "twice")
        .when(F.col("_n1") | F.col("_n2"), "exact")
        .otherwise("never")
    )
    at = F.when(fixed.isNotNull(), t - fixed * F.lit(_MINUTE)).when(F.col("_n1"), F.col("_one")).when(F.col("_n2"), F.col("_two"))
    return df.withColumn(f"{out}_how", how).withColumn(out, F.when(F.col(f"{out}_how") == "exact", at)).drop("_one", "_two", "_n1", "_n2")


def _mixture(rounds: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """EM of one source. Each row holds a set of possible readings and how many texts have it, so a group has at most as many rows as there are sets of readings."""
        sets = [tuple(x) for x in pdf["readings"]]
        names = sorted({r for s in sets for r in s})
        weight = dict.fromkeys(names, 1.0 / len(names))
        for _ in range(rounds):
            got = dict.fromkeys(names, 0.5)  # half a text beforehand, so that an unseen reading stays possible
            for s, n in zip(sets, pdf["n"], strict=True):
                whole = sum(weight[r] for r in s)
                for r in s:
                    got[r] += n * weight[r] / whole
            total = sum(got.values())
            weight = {r: x / total for r, x in got.items()}
        return pd.DataFrame({"source": [pdf["source"].iloc[0]] * len(names), "reading": names, "weight": [weight[r] for r in names]})

    return fit


def normalise_instants(
    df: DataFrame, keys: list[str], text: str, source: str, region: str, *, day_is_midnight: str, rounds: int = 25
) -> DataFrame:
    """keys, notation, status, instant_us, likely_us, likely_posterior for each row of df.

    text: column with the text; source: column whose values write alike (null is a source of its own); region: column
    with the zone of texts without one (null: unknown); day_is_midnight: boolean column, true where a day alone means
    its first moment.
    """
    spark = df.sparkSession
    zones = known_zones(spark)
    d = df.select(
        *keys,
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.regexp_replace(F.col(text), r"^[\s\u00a0\u3000\ufeff]+|[\s\u00a0\u3000\ufeff]+$", "").alias("_t"),
        F.col(region).alias("_given"),
        F.col(day_is_midnight).alias("_midnight"),
    )
    kind = None
    for n in NOTATIONS:
        hit = F.col("_t").rlike(n.pattern)
        kind = F.when(hit, n.name) if kind is None else kind.when(hit, n.name)
    d = d.withColumn("notation", kind)
    d = d.withColumn("_parts", _parts(F.col("notation"), F.col("_t")))
    get = {r: _part(F.col("notation"), F.col("_parts"), r) for r in "y v m d a b n h i s f p z o r w e E".split()}
    num = lambda r: get[r].cast("int")
    d = d.select(
        "*",
        F.coalesce(num("y"), F.when(num("v") >= 50, num("v") + 1900).otherwise(num("v") + 2000)).alias("_y"),
        F.coalesce(num("m"), _lookup(MONTHS, F.lower(get["n"])), num("b")).alias("_m1"),
        F.coalesce(num("d"), num("a")).alias("_d1"),
        num("a").alias("_m2"),
        num("b").alias("_d2"),
        num("h").alias("_h0"),
        num("i").alias("_i"),
        num("s").alias("_s0"),
        F.rpad(F.substring(get["f"], 1, 6), 6, "0").cast("bigint").alias("_f"),
        F.lower(get["p"]).alias("_p"),
        F.coalesce(get["z"], get["o"]).alias("_z"),
        get["r"].alias("_r"),
        F.lower(get["w"]).alias("_w"),
        F.coalesce(get["e"].cast("bigint") * 1_000_000, get["E"].cast("bigint") * 1000).alias("_epoch"),
    )
    hour = F.when(F.col("_p").isNull(), F.col("_h0")).when(F.col("_h0").between(1, 12), F.col("_h0") % 12 + F.when(F.col("_p") == "pm", 12).otherwise(0)).otherwise(99)
    clock_ok = hour.between(0, 23) & F.col("_i").between(0, 59) & F.coalesce(F.col("_s0"), F.lit(0)).between(0, 59)
    clock = F.when(F.col("_h0").isNull(), F.when(F.col("_midnight"), F.lit(0).cast("bigint"))).when(
        clock_ok, ((hour * 60 + F.col("_i")) * 60 + F.coalesce(F.col("_s0"), F.lit(0))).cast("bigint") * 1_000_000 + F.coalesce(F.col("_f"), F.lit(0))
    )
    weekday = F.element_at(F.array(*[F.lit(x) for x in "thu fri sat sun mon tue wed".split()]), (F.pmod(F.col("_day1"), F.lit(7)) + 1).cast("int"))
    d = d.withColumn("_day1", _days(F.col("_y"), F.col("_m1"), F.col("_d1"))).withColumn("_day2", _days(F.col("_y"), F.col("_m2"), F.col("_d2")))
    # a day of the week that isn't the date's: no real date
    d = d.withColumn("_day1", F.when(F.col("_w").isNull() | (F.col("_w") == weekday), F.col("_day1"))).withColumn("_clock", clock)
    sign = F.when(F.col("_z").startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(F.col("_z"), "[^0-9]", "")
    span_h, span_m = F.substring(digits, 1, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))
    numeric = F.when(F.col("_z").rlike("^[+-]") & (span_h <= 18) & (span_m <= 59), sign * (span_h * 60 + span_m))
    d = d.withColumn("_minutes", F.coalesce(numeric, _lookup(ABBREVIATIONS, F.col("_z"))).cast("bigint"))
    written = F.coalesce(F.when(F.col("_z").contains("/"), F.col("_z")), F.when(F.col("_z").isNull(), F.col("_r")))
    d = d.withColumn("_region", F.when(F.col("_z").isNull() & F.col("_r").isNull(), F.col("_given")).otherwise(written))
    # a fixed offset beats no region; a region given in a column may itself be UTC
    d = d.withColumn("_minutes", F.when(F.col("_minutes").isNull() & (F.col("_region") == "UTC"), F.lit(0).cast("bigint")).otherwise(F.col("_minutes")))
    d = d.withColumn("_local1", F.col("_day1") * F.lit(_DAY) + F.col("_clock")).withColumn("_local2", F.col("_day2") * F.lit(_DAY) + F.col("_clock"))
    d = _resolve(d, "_local1", "_at1", zones)
    d = _resolve(d, "_local2", "_at2", zones)
    slashed = F.col("notation") == "slashed"
    first = F.when(slashed, "day_first").otherwise(F.col("notation"))
    # readings that are possible by the calendar
    d = d.withColumn(
        "readings",
        F.array_compact(
            F.array(
                F.when(F.col("_epoch").isNotNull(), F.col("notation")),
                F.when(F.col("_day1").isNotNull(), first),
                F.when(slashed & F.col("_day2").isNotNull() & ~F.col("_day1").eqNullSafe(F.col("_day2")), F.lit("month_first")),
            )
        ),
    )
    # read twice below, and a filter on the status must not be pushed down through all of the above, which would copy its expressions into each other
    d = cut_lineage(d.select(*keys, "source", "notation", "readings", "_epoch", "_day1", "_h0", "_clock", "_z", "_minutes", "_region", "_at1", "_at1_how", "_at2", "_at2_how"))
    counts = d.where(F.size("readings") > 0).groupBy("source", "readings").agg(F.count(F.lit(1)).alias("n"))
    weights = counts.groupBy("source").applyInPandas(_mixture(rounds), "source string, reading string, weight double")
    day_first = weights.where(F.col("reading") == "day_first").select("source", F.col("weight").alias("_wd"))
    month_first = weights.where(F.col("reading") == "month_first").select("source", F.col("weight").alias("_wm"))
    both = day_first.join(month_first, "source", "full")
    # only texts with two readings need their source's weights; the rest passes by without a join
    one = d.where(F.size("readings") <= 1).withColumn("_wd", F.lit(None).cast("double")).withColumn("_wm", F.lit(None).cast("double"))
    two = d.where(F.size("readings") > 1).join(both, "source", "left")
    d = one.unionByName(two)
    share = F.coalesce(F.col("_wd") / (F.col("_wd") + F.col("_wm")), F.lit(0.5))
    many = F.size("readings") > 1
    takes_first = F.when(many, share >= 0.5).otherwise(F.col("_day1").isNotNull())
    how = F.when(F.col("_day1").isNotNull(), F.col("_at1_how")).otherwise(F.col("_at2_how"))
    status = (
        F.when(F.col("_epoch").isNotNull(), "exact")
        .when(F.size("readings") == 0, "not_a_date")
        .when(F.col("_h0").isNotNull() & F.col("_clock").isNull(), "not_a_date")
        .when(F.col("_clock").isNull(), "no_time")
        .when(many & ~F.col("_at1").eqNullSafe(F.col("_at2")), "ambiguous")
        .when(F.col("_z").isNotNull() & F.col("_minutes").isNull() & F.col("_region").isNull(), "no_zone")
        .otherwise(how)
    )
    d = d.withColumn("status", F.coalesce(status, F.lit("not_a_date")))
    # a reading that is possible has a weight above zero, so an instant has posterior 1 only if all possible readings give it
    one_instant = F.col("_at1").eqNullSafe(F.col("_at2"))
    posterior = F.when(many, F.when(one_instant, F.lit(1.0)).when(takes_first, share).otherwise(1 - share)).when(F.size("readings") == 1, F.lit(1.0))
    return d.select(
        *keys,
        "notation",
        "status",
        F.when((F.col("status") == "exact") & (posterior == 1.0), F.coalesce(F.col("_epoch"), F.col("_at1"), F.col("_at2"))).alias("instant_us"),
        F.coalesce(F.col("_epoch"), F.when(takes_first, F.col("_at1")).otherwise(F.col("_at2"))).alias("likely_us"),
        posterior.alias("likely_posterior"),
    )


def record_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claimed_time, not_before and not_after of all records, one row per value that is not null."""
    places = table(spark, sf_dir, "places").groupBy("place").agg(F.max("zone").alias("zone"))
    sigs = one_per_id(table(spark, sf_dir, "signatures"), "sig_id", "claimed_time", "location").join(places, F.col("location") == F.col("place"), "left")
    sigs = sigs.select(F.lit("claimed_time").alias("field_name"), F.col("sig_id").alias("row_id"), F.col("claimed_time").alias("raw"), F.col("location").alias("writer"), F.col("zone").alias("home"), F.lit(False).alias("midnight"))
    certs = one_per_id(table(spark, sf_dir, "certificates"), "cert_id", "not_before", "not_after", "issuer")
    certs = certs.select("cert_id", "issuer", F.explode(F.create_map(F.lit("not_before"), F.col("not_before"), F.lit("not_after"), F.col("not_after"))).alias("field_name", "raw"))
    certs = certs.select("field_name", F.col("cert_id").alias("row_id"), "raw", F.col("issuer").alias("writer"), F.lit("UTC").alias("home"), F.lit(True).alias("midnight"))
    values = sigs.unionByName(certs).where(F.col("raw").isNotNull())
    return normalise_instants(values, ["field_name", "row_id"], "raw", "writer", "home", day_is_midnight="midnight")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose likeliest instant has posterior 1."""
    return record_instants(spark, sf_dir).where((F.col("likely_posterior") == 1.0) & F.col("instant_us").isNotNull()).select("field_name", "row_id", "instant_us")


def p3_likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ambiguous values: the reading that their source's other values speak for, and its posterior."""
    return record_instants(spark, sf_dir).where(F.col("status") == "ambiguous").select("field_name", "row_id", "notation", "likely_us", "likely_posterior")


def p3_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field have each notation and status."""
    return record_instants(spark, sf_dir).groupBy("field_name", "notation", "status").agg(F.count(F.lit(1)).alias("values"), F.count("likely_us").alias("chosen"))
