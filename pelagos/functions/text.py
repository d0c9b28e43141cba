"""Column expressions that name, classify and format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagos.functions.constants import COMPASS, KNOTS_PER_MS, MONTH_NAMES
from pelagos.functions.numeric import half_up


def fixed(x: Column, digits: int) -> Column:
    """With so many decimals, halves up: rounded as a number first, then put together from whole parts."""
    n = F.floor(F.abs(x) * 10**digits + 0.5).cast("long")
    sign = F.when((x < 0) & (n > 0), "-").otherwise("")
    if not digits:
        return F.concat(sign, n.cast("string"))
    return F.concat(sign, F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def percent(p: Column) -> Column:
    return F.when(p.isNull(), "no data").when(p < 0.05, "<0.1%").when(p < 10, F.concat(fixed(p, 1), F.lit("%"))).otherwise(F.concat(fixed(p, 0), F.lit("%")))


def days_a_month(p: Column) -> Column:
    d = p * 0.3044
    return F.when((p > 0) & (d < 0.05), "under 0.1").when(d < 3, fixed(d, 1)).otherwise(fixed(d, 0))


def height(h: Column) -> Column:
    return F.when(h * 2 == F.floor(h * 2), fixed(h, 1)).otherwise(fixed(h, 2))


def lat_lon(lat: Column, lon: Column) -> Column:
    one = lambda v, pos, neg: F.concat(fixed(F.abs(v), 2), F.lit("° "), F.when(v < 0, neg).otherwise(pos))
    return F.concat_ws(", ", one(lat, "N", "S"), one(lon, "E", "W"))


def degrees_minutes(v: Column, positive: str, negative: str) -> Column:
    """Degrees and decimal minutes; sixty minutes carry over."""
    a = F.abs(v)
    thousandths = F.floor((a - F.floor(a)) * 60000 + 0.5).cast("long")
    carry = thousandths >= 60000
    d, m = F.floor(a).cast("long") + F.when(carry, 1).otherwise(0), F.when(carry, thousandths - 60000).otherwise(thousandths)
    return F.concat(d.cast("string"), F.lit("° "), F.floor(m / 1000).cast("string"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"), F.lit("′ "), F.when(v < 0, negative).otherwise(positive))


def solar_time(h: Column) -> Column:
    minutes = F.floor(h * 60 + 0.5).cast("long")
    return F.concat_ws(":", F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(F.pmod(degrees, F.lit(360.0)) / 22.5 + 0.5).cast("int") % 16) + 1)


def speed(ms: Column) -> Column:
    """Metres a second with two decimals, less one trailing 0, and knots."""
    return F.concat(F.regexp_replace(fixed(ms, 2), "0$", ""), F.lit(" m/s ("), F.regexp_replace(fixed(ms * KNOTS_PER_MS, 1), "$", " kn)"))


def distance(km: Column) -> Column:
    nm = km / 1.852
    return (
        F.when(km < 1, F.concat(fixed(km * 1000, 0), F.lit(" m  ·  "), fixed(nm, 2), F.lit(" nm")))
        .when(km < 100, F.concat(fixed(km, 2), F.lit(" km  ·  "), fixed(nm, 2), F.lit(" nm")))
        .otherwise(F.concat(F.format_number(half_up(km), 0), F.lit(" km  ·  "), F.format_number(half_up(nm), 0), F.lit(" nm")))
    )


def capital_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**30))


def storm_category(kt: Column) -> Column:
    return F.when(kt < 34, None).when(kt < 64, "tropical storm strength").when(kt < 83, "Category 1").when(kt < 96, "Category 2").when(kt < 113, "Category 3").when(kt < 137, "Category 4").when(kt >= 137, "Category 5")


def storm_category_on_map(kt: Column) -> Column:
    """The map's own wording: empty without a wind, and a name for weak systems."""
    return F.when(~F.coalesce(kt > 0, F.lit(False)), "").when(kt < 34, "Below tropical storm strength").otherwise(capital_first(storm_category(kt)))


def storm_word(lat: Column, lon: Column) -> Column:
    """What a tropical storm is called in these waters; empty where there are none."""
    return F.when(lat < 0, "cyclone").when((lat >= 30) & (lon >= 0) & (lon < 60), "").when((lat >= 50) & ((lon <= -100) | (lon >= 140)), "").when(lon >= 100, "typhoon").when(lon >= 30, "cyclone").otherwise("hurricane")


def storm_heading(lat: Column, lon: Column) -> Column:
    """Storms that have left the tropics are named too beyond 35 degrees."""
    word = storm_word(lat, lon)
    cap = capital_first(word)
    ex = F.abs(lat) > 35
    return F.when((word == "") & ex, "Tropical and ex-tropical cyclones").when(word == "", "Tropical cyclones").when(ex, F.concat(cap, F.lit("s and ex-"), word, F.lit("s"))).otherwise(F.concat(cap, F.lit("s")))


def tide_type(form: Column) -> Column:
    return F.when(form < 0.25, "Semidiurnal, peaks about every 6.2 h").when(form <= 1.5, "Mixed, mainly semidiurnal, peaks about every 6 h").when(form <= 3, "Mixed, mainly diurnal, one strong and one weak peak a day").otherwise("Diurnal, peaks about every 12.4 h")


def slack_water(spring: Column, neap: Column, slack50: Column, per_day: Column) -> Column:
    """How long the stream stands at its turns; nothing is said of weak streams."""
    times = F.when(per_day >= 1, F.concat(F.lit(", "), fixed(per_day, 0), F.lit(" times a day"))).otherwise("")
    about = F.concat(F.lit("About "), fixed(slack50, 0), F.lit(" min below 1 kn at each turn"), times)
    return F.when(~(spring > 0.5), None).when(slack50 == 0, "None: the stream turns without stopping").when((neap > 0.5) & slack50.isNotNull() & (slack50 < 999), about).when(neap <= 0.5, "Long spells at neaps, short at springs")


#: Words in a well's status that tell whether it is in service; the first set wins.
NOT_IN_SERVICE = "abandon|plug|p&a|paa|junk|dry|cancel|wildcat|apprais|explor|soil|stratigraphic"
IN_SERVICE = "produc|inject|develop|operat|online|in service|active|completed|suspend|shut|drill"


def in_service(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return ~s.rlike(NOT_IN_SERVICE) & s.rlike(IN_SERVICE)


def status_label(status: Column, words: dict[str, str]) -> Column:
    """A dictionary's word for a status, else the status itself, trimmed and in lower case."""
    key = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), key), key)


def track_name(name: Column) -> Column:
    return F.when(name.isNull() | (F.upper(name) == "NOT_NAMED") | (name == ""), "Unnamed storm").otherwise(name)


def month_runs(months: Column) -> Column:
    """Ascending months 0 .. 11 as runs around the year: "Nov to Feb", "Jun and Jul", "Mar"."""
    names = F.array(*map(F.lit, MONTH_NAMES))
    name = lambda m: F.element_at(names, (m % 12).cast("int") + 1)
    starts = F.filter(months, lambda m: ~F.array_contains(months, F.pmod(m - 1, F.lit(12)).cast("int")))
    # a run is as long as months follow; it ends before the first that is missing
    ahead = lambda s: F.filter(F.sequence(F.lit(1), F.lit(12)), lambda k: ~F.array_contains(months, ((s + k) % 12).cast("int")))
    text = lambda s, n: F.when(n == 1, name(s)).when(n == 2, F.concat_ws(" and ", name(s), name(s + 1))).otherwise(F.concat_ws(" to ", name(s), name(s + n - 1)))
    return F.when(F.size(months) == 12, F.lit("Jan to Dec")).otherwise(F.array_join(F.transform(starts, lambda s: text(s, F.get(ahead(s), F.lit(0)))), ", "))


def months_label(months: Column) -> Column:
    return F.when(F.size(months) == 12, "across the whole year").when(F.size(months) == 0, "(no months selected)").otherwise(F.concat(F.lit("in "), month_runs(months)))


def month_list(months: Column) -> Column:
    """For reports: names one by one."""
    return F.when(F.size(months) == 12, "All year").otherwise(F.array_join(F.transform(months, lambda m: F.element_at(F.array(*map(F.lit, MONTH_NAMES)), m + 1)), ", "))


def data_months(used: Column, chosen: Column) -> Column:
    """Which of the chosen months a figure is about; its words are fixed values."""
    some = (F.size(used) > 0) & (F.size(used) < F.size(chosen))
    return F.when(some, F.concat(F.lit("in the months with open water ("), month_runs(used), F.lit(")"))).otherwise(months_label(chosen))


def no_data_note(used: Column, chosen: Column) -> Column:
    """What to say of chosen months without data; nothing if none or all lack it. Its words are fixed values."""
    some = (F.size(used) > 0) & (F.size(used) < F.size(chosen))
    return F.when(some, F.concat(F.lit(" No wave data in "), month_runs(F.array_except(chosen, used)), F.lit(", usually because of sea ice."))).otherwise("")


#: Hosts by which visits are grouped, in order.
HOSTS = (
    (r"(^|\.)google\.", "google"),
    (r"(^|\.)bing\.com$", "bing"),
    (r"duckduckgo\.com$", "duckduckgo"),
    (r"linkedin\.com$|^lnkd\.in$", "linkedin"),
    (r"(^|\.)(t\.co|x\.com|twitter\.com)$", "x"),
    (r"facebook\.com$", "facebook"),
    (r"chatgpt\.com$|openai\.com$", "chatgpt"),
    (r"perplexity\.ai$", "perplexity"),
)


def traffic_source(url: Column, referrer: Column) -> Column:
    """The campaign that a URL names, else a group of the referrer's host, else direct."""
    raw = F.regexp_extract(url, r"[?&]utm_source=([^&#]*)", 1)
    tag = F.substring(F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(raw), raw)), r"[^a-z0-9_.-]", ""), 1, 40)
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(referrer, F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")
    group = F.substring(host, 1, 40)
    for pattern, name in reversed(HOSTS):
        group = F.when(host.rlike(pattern), name).otherwise(group)
    return F.when(tag != "", tag).when(host != "", group).otherwise("direct")


def page_class(path: Column) -> Column:
    p = F.regexp_replace(path, "/+$", "/")
    slug = F.regexp_extract(p, r"/locations/([a-z0-9-]+)\.html$", 1)
    return F.when(p.rlike(r"/locations/(index\.html)?$"), "locations").when(slug != "", F.concat(F.lit("loc:"), slug)).when(p.rlike(r"methodology\.html$"), "how").otherwise("home")


def campaign_link(base: Column, content: Column, medium: str, source: str) -> Column:
    sign = F.when(base.contains("?"), "&").otherwise("?")
    return F.concat(base, sign, F.lit(f"utm_source={source}&utm_medium={medium}&utm_content="), content)


def share_link(lat: Column, lon: Column, months: Column, limit: Column, default: float, window_limit: Column, window_hours: Column) -> Column:
    """loc=..&m=..&h=..&wt=..&wd=..: what differs from the defaults; months from 1. A window has both a limit and a duration, or is left out."""
    some = (F.size(months) > 0) & (F.size(months) < 12)
    return F.concat_ws(
        "&",
        F.concat(F.lit("loc="), fixed(lat, 2), F.lit(","), fixed(lon, 2)),
        F.when(some, F.concat(F.lit("m="), F.array_join(F.transform(months, lambda m: (m + 1).cast("string")), ","))),
        F.when(limit != default, F.concat(F.lit("h="), F.regexp_replace(fixed(limit, 2), r"\.?0+$", ""))),
        F.when(window_hours.isNotNull(), F.concat(F.lit("wt="), F.regexp_replace(fixed(window_limit, 2), r"\.?0+$", ""))),
        F.when(window_limit.isNotNull(), F.concat(F.lit("wd="), window_hours.cast("string"))),
    )


def parsed_link(link: Column, low: float = 0.25, high: float = 15.0) -> Column:
    """struct(lat, lon, months, limit, wt, wd) of a share link; null if it names no place on earth."""
    kv = F.str_to_map(F.regexp_replace(link, "^[#?]", ""), F.lit("&"), F.lit("="))
    get = lambda k: F.try_element_at(kv, F.lit(k))
    place = F.split(get("loc"), ",")
    lat, lon = F.get(place, F.lit(0)).try_cast("double"), F.get(place, F.lit(1)).try_cast("double")
    months = F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(F.split(get("m"), ","), lambda s: s.try_cast("int")), lambda m: m.between(1, 12)), lambda m: m - 1)))
    h = get("h").try_cast("double")
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon"), F.when(F.size(months) > 0, months).alias("months"), F.when(h > 0, F.least(F.lit(high), F.greatest(F.lit(low), h))).alias("limit"), get("wt").try_cast("double").alias("wt"), get("wd").try_cast("int").alias("wd")))
