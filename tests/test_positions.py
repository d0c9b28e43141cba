"""Positions from free text: expected places and errors, worked out by hand from the rule."""

from pelagos.functions.position import ERRORS, read_positions

CASES = [
    ("56 30.25 N, 3 12.5 E", (56.504167, 3.208333)),
    ("-12.5, 130.8", (-12.5, 130.8)),
    ("56°30'15\"N 3°12'30\"E", (56.504167, 3.208333)),
    ("3.5 E, 56.25 N", (56.25, 3.5)),
    ("N56 30 W003 12", (56.5, -3.2)),
    ("N 56 30 E 3", (56.0, 30.05)),
    (".5 .25", (0.5, 0.25)),
    ("−12.5; 190", (-12.5, -170.0)),
    ("12 S / 400 E", "longitude"),
    ("56 30 N 3", "uneven"),
    ("10 -20 30", "uneven"),
    ("12 60 N, 3 E", "minutes"),
    ("1 2 60, 3", "seconds"),
    ("95, 10", "latitude"),
    ("1,2,3", "separators"),
    ("", "empty"),
    (" \t", "empty"),
    (None, "empty"),
    ("hello", "unreadable"),
    ("12~ 3", "unreadable"),
    ("12.5 30 N, 4 E", "half_decimals"),
    ("10 -20, 5", "half_sign"),
    ("N 10 N 20", "axis"),
    ("N 10 E 20 W", "letters"),
    ("10 N 20 S", (10.0, 20.0)),  # an S that follows a number and ends a word stands for seconds,
    ("N 10 S, 20", "half_letters"),
    ("N, 20", "half_empty"),
    ("1 2 3 4, 5", "half_long"),
]


def test_positions(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "id int, txt string")
    got = {row.id: row for row in read_positions(df, "txt", "id").collect()}
    for k, (text, want) in enumerate(CASES):
        found = got[k]
        if isinstance(want, str):
            assert (found.error, found.lat, found.lon) == (ERRORS[want], None, None), text
        else:
            assert (round(found.lat, 6), round(found.lon, 6), found.error) == (*want, None), text
