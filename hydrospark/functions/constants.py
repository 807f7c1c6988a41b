"""Unit factors and the like, to the last digit."""

FT_TO_M = 0.3048
M_TO_FT = 3.280839895013123
M2_PER_SQMI = 2_589_988.110336
SQMI_TO_KM2 = 2.589988110336
KM2_TO_SQMI = 0.3861021585424458
CFS_TO_CMS = 0.028316846592
#: The factor for series that arrive in m3/s outside hydrograph normalisation, which divides by CFS_TO_CMS.
CMS_TO_CFS = 35.3146667215
SQMI_INCH_TO_FT3 = 5280.0 * 5280.0 / 12.0
FT3_TO_M3 = 0.028316846592
MM_PER_IN = 25.4
KM_PER_DEGREE = 111.32
LEAST_COS_LAT = 0.2
EARTH_RADIUS_KM = 6371.0088
RASTER_NODATA = -9999.0
EPS = 1e-12
#: Curve numbers by antecedent wetness.
CURVE_NUMBERS = {"dry": 75.0, "normal": 85.0, "wet": 92.0}
#: Depth colour ramp: stop, red, green, blue.
DEPTH_RAMP = ((0.0, 185, 236, 255), (0.2, 86, 199, 244), (0.5, 34, 126, 208), (0.78, 37, 64, 177), (1.0, 71, 33, 130))
#: Words without weight in waterway names.
WATERWAY_STOP_WORDS = ("at", "near", "nr", "above", "below", "houston", "tx", "texas", "street", "st", "road", "rd", "drive", "dr")
CFS_UNITS = ("cfs", "ft3/s", "ft^3/s", "ft3s")
CMS_UNITS = ("cms", "m3/s", "m^3/s", "m3s")
#: The slug of a name that has no letter or figure.
EMPTY_SLUG = "selected_bayou"
