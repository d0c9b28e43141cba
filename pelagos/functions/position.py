"""Free-text positions as column expressions: a text becomes numbers and letters, these become two halves, and each half is read by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import geo

#: What can be wrong with a text, in this project's words.
ERRORS = {
    "empty": "No position given.",
    "unreadable": "The text holds something that is neither a number nor one of N, S, E, W.",
    "separators": "One separator at most may stand between the two values; decimals take a point.",
    "letters": "There are more than two hemisphere letters.",
    "uneven": "Without a separator both values need equally many numbers.",
    "half_letters": "A value has two hemisphere letters.",
    "half_empty": "A value has no number.",
    "half_long": "A value has more than degrees, minutes and seconds.",
    "half_sign": "A sign may stand before degrees only.",
    "half_decimals": "Decimals may stand in a value's last number only.",
    "minutes": "Minutes end below 60.",
    "seconds": "Seconds end below 60.",
    "axis": "Both values lie on the same axis.",
    "latitude": "The latitude lies beyond a pole.",
    "longitude": "The longitude lies beyond a full turn.",
}
_NUMBER = r"[+-]?\d+(?:\.\d+)?"
#: A letter that opens a value, as it touches a number, bears a tilde.
_TOKEN = rf"{_NUMBER}|[NSEW]~?"


def _is_letter(token: Column) -> Column:
    return token.rlike("^[NSEW]")


def _is_number(token: Column) -> Column:
    return ~token.rlike("^[NSEW]")


def _plain(text: Column) -> Column:
    """Capitals, with plain minus signs, without marks and unit letters."""
    for pattern, to in (
        ("[−–—]", "-"),
        (r"(?<!\d)\.(?=\d)", "0."),
        (r"(?<=\d)\s*[MS](?=[\s0-9.+-]|$)", " "),
        ("[°º˚]", " "),
        (r"(?<=\d)\s*D(?=[\s0-9.+-]|$)", " "),
        ("[′’´`'″”\"  ]", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def _half(tokens: Column) -> list[Column]:
    letters, numbers = F.filter(tokens, _is_letter), F.filter(tokens, _is_number)
    return [letters.alias("letters"), numbers.alias("numbers"), F.transform(numbers, lambda x: F.abs(x.cast("double"))).alias("sizes")]


def _half_error(h: str) -> Column:
    numbers, sizes = F.col(f"{h}.numbers"), F.col(f"{h}.sizes")
    n = F.size(numbers)
    before_last = F.slice(sizes, F.lit(1), F.greatest(n - 1, F.lit(0)))
    after_first = F.slice(numbers, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return (
        F.when(F.size(f"{h}.letters") > 1, "half_letters")
        .when(n == 0, "half_empty")
        .when(n > 3, "half_long")
        .when(F.exists(after_first, lambda x: x.rlike("^[+-]")), "half_sign")
        .when(F.exists(before_last, lambda x: x % 1 != 0), "half_decimals")
        .when(F.get(sizes, F.lit(1)) >= 60, "minutes")
        .when(F.get(sizes, F.lit(2)) >= 60, "seconds")
    )


def _half_value(h: str) -> Column:
    part = lambda k: F.coalesce(F.get(F.col(f"{h}.sizes"), F.lit(k)), F.lit(0.0))
    size = part(0) + part(1) / 60 + part(2) / 3600
    letter, minus = F.get(F.col(f"{h}.letters"), F.lit(0)), F.get(F.col(f"{h}.numbers"), F.lit(0)).startswith("-")
    return F.when(F.coalesce(letter.rlike("^[SW]"), minus), -size).otherwise(size)


def _axis(h: str) -> Column:
    letter = F.get(F.col(f"{h}.letters"), F.lit(0))
    return F.when(letter.rlike("^[NS]"), "lat").when(letter.isNotNull(), "lon")


def read_positions(texts: DataFrame, text: str, by: str) -> DataFrame:
    """(by, lat, lon, error): the place that a text names, or what is wrong with it; lon is wrapped.

    Values are degrees, degrees and minutes, or degrees, minutes and seconds, with a sign or with a hemisphere letter on
    either side. A comma, semicolon or slash divides the two; without one, two letters are divided where both sides have
    numbers most alike in count (the first such place), else the numbers are halved. Null and blank texts are errors.
    """
    rows = texts.select(by, _plain(F.upper(F.col(text))).alias("plain"))
    rest = F.regexp_replace("plain", rf"{_NUMBER}|[NSEW]|[,;/]|\s", "")
    marked = F.split(F.regexp_replace("plain", r"([NSEW])(?=[0-9.+-])", "$1~"), "[,;/]")
    rows = rows.select(by, "plain", rest.alias("rest"), F.transform(marked, lambda p: F.regexp_extract_all(p, F.lit(_TOKEN), F.lit(0))).alias("parts"))
    tokens = F.get("parts", F.lit(0))
    letter_at = F.filter(F.transform(tokens, lambda t, i: F.when(_is_letter(t), i)), lambda i: i.isNotNull())
    number_at = F.filter(F.transform(tokens, lambda t, i: F.when(_is_number(t), i)), lambda i: i.isNotNull())
    rows = rows.select("*", tokens.alias("tokens"), letter_at.alias("letter_at"), number_at.alias("number_at"))
    n, first, second = F.size("number_at"), F.get("letter_at", F.lit(0)), F.get("letter_at", F.lit(1))
    unevenness = lambda c: F.abs(2 * F.size(F.filter("number_at", lambda i: i < c)) - n)
    two = F.array_min(F.transform(F.sequence(first + 1, second), lambda c: F.struct(unevenness(c).alias("d"), c.alias("c"))))["c"]
    middle = F.get("number_at", (n / 2).cast("int") - 1) + 1
    closes = F.coalesce(F.get("tokens", middle).rlike("^[NSEW]$"), F.lit(False))
    cut = F.when(F.size("letter_at") == 2, two).otherwise(middle + F.when(closes, 1).otherwise(0))
    shape = (
        F.when(F.coalesce(F.col("plain").rlike(r"^\s*$"), F.lit(True)), "empty")
        .when(F.size("parts") > 2, "separators")
        .when(F.col("rest") != "", "unreadable")
        .when((F.size("parts") == 1) & (F.size("letter_at") > 2), "letters")
        .when((F.size("parts") == 1) & (F.size("letter_at") < 2) & ((n == 0) | (n % 2 != 0)), "uneven")
    )
    rows = rows.select("*", shape.alias("shape"), F.when(shape.isNull() & (F.size("parts") == 1), cut).alias("cut"))
    one = F.col("cut").isNotNull()
    a = F.when(one, F.slice("tokens", F.lit(1), F.col("cut"))).otherwise(F.get("parts", F.lit(0)))
    b = F.when(one, F.slice("tokens", F.col("cut") + 1, F.size("tokens"))).otherwise(F.get("parts", F.lit(1)))
    rows = rows.select(by, "shape", a.alias("ta"), b.alias("tb")).select(by, "shape", F.struct(*_half(F.col("ta"))).alias("a"), F.struct(*_half(F.col("tb"))).alias("b"))
    rows = rows.select(by, F.coalesce("shape", _half_error("a"), _half_error("b")).alias("why"), *(f.alias(n) for n, f in {"x": _half_value("a"), "y": _half_value("b"), "xa": _axis("a"), "ya": _axis("b")}.items()))
    swapped = F.coalesce(F.col("xa") == "lon", F.lit(False)) | F.coalesce(F.col("ya") == "lat", F.lit(False))
    rows = rows.select(by, "why", (F.col("xa") == F.col("ya")).alias("same"), F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("lat"), F.when(swapped, F.col("x")).otherwise(F.col("y")).alias("lon"))
    why = F.coalesce("why", F.when(F.col("same"), "axis").when(F.abs("lat") > 90, "latitude").when(F.abs("lon") > 360, "longitude"))
    words = F.create_map(*(F.lit(x) for kv in ERRORS.items() for x in kv))
    rows = rows.select(by, "lat", "lon", why.alias("why"))
    ok = F.col("why").isNull()
    return rows.select(by, F.when(ok, F.col("lat")).alias("lat"), F.when(ok, geo.wrap_lon(F.col("lon"))).alias("lon"), F.when(~ok, F.element_at(words, F.col("why"))).alias("error"))
