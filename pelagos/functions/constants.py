"""Fixed values that are part of the results."""

#: Days of each month, leap years averaged: the weights of months.
MONTH_DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Wave heights, in metres, of the exceedance curve.
THRESHOLDS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0)
#: Limits (m) and durations (h) of weather windows, and the mean run (h) of each duration bin.
WINDOW_LIMITS = (1.0, 1.5, 2.0, 2.5, 3.0)
WINDOW_EDGES = (6, 12, 24, 48, 72, 120)
BIN_MEAN_H = (3.0, 7.5, 16.5, 34.5, 58.5, 94.5, 180.0)
OPEN_END_H = 240
#: Earth radii (km): of statistics, and of the ruler.
EARTH_KM, RULER_KM = 6371.0, 6371.0088
KNOTS_PER_MS, KM_PER_NM = 1.94384, 1.852
#: Snap radii (km): waves, currents, cyclones, assets.
SNAP_KM = {"waves": 350.0, "currents": 120.0, "cyclones": 170.0, "assets": 400.0}
DEFAULT_LIMIT, LOWEST_LIMIT, HIGHEST_LIMIT = 2.0, 0.25, 15.0
#: Peak wind (knots) from which storm categories begin.
STORM_KNOTS = (34, 64, 83, 96, 113, 137)
#: Wind-driven current: share of the wind, depth (m) at which it ends, and the tidal profile's exponent.
WIND_SHARE, WIND_DEPTH, TIDE_POWER = 0.03, 50.0, 1 / 7
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
PHASES = ("El Nino", "Neutral", "La Nina")
SEASONS = {"DJF": "Dec to Feb", "MAM": "Mar to May", "JJA": "Jun to Aug", "SON": "Sep to Nov"}
#: Mean years in which the standard deviation of a Gumbel variable counts: Euler's constant.
EULER = 0.5772156649015329
