"""Conventions every operator shares (fixed values).

Internal units are metres, degrees Celsius and decimal years; a positive value is a rise
of the level.
"""

import math

OCEAN_AREA_M2 = 3.625e14
GT_PER_MM = 362.5
GT_TO_M = 1.0 / 362_500.0
SECONDS_PER_YEAR = 365.25 * 86_400
BASELINE_YEAR = 2000.0
BASELINE_WINDOW = (1995, 2005)
ONSET_YEAR = 2010.0
N_SAMPLES = 2000
SCENARIOS = ("ssp119", "ssp126", "ssp245", "ssp370", "ssp585")
PROJECTION_GRID = (1950, 2150)
PREINDUSTRIAL_TO_BASELINE_M = 0.19
Z_90, Z_94, Z_95 = 1.645, 1.881, 1.96
SEA_WATER_DENSITY = 1028.0
ICE_DENSITY = 917.0
SIGN_TAGS = ("slr", "glaciology", "storage")
MAX_ABS_LEVEL_M = 2.0
EARTH_RADIUS_M = 6_371_000.0
# Damage knots, level in metres and annual cost in billions of dollars.
DAMAGE_KNOTS_M = (0.0, 0.2, 0.52, 0.63, 0.86, 1.8)
DAMAGE_KNOTS_BUSD = (0.0, 1000.0, 10200.0, 11700.0, 14000.0, 27000.0)
CAPITAL_PER_M_BUSD, DISCOUNT, HORIZON_YEARS, P_STABLE = 4000.0, 0.03, 75, 0.10
# Instability scenarios with weight, 5th and 95th percentile in mm, log-space shape, exponent's log-location and log-scale.
INSTABILITY = {
    "S1": (0.10, 25.0, 85.0, 0.0, 0.0, 0.0),
    "S2": (0.80, 150.0, 1000.0, 4.0, math.log(1.8), 0.3),
    "S3": (0.10, 600.0, 1300.0, -3.0, math.log(2.2), 0.3),
}
RHEOLOGY_MEAN, RHEOLOGY_SIGMA, RHEOLOGY_SLOPE = 1.28, 0.07, 0.28
EXPONENT_MEAN, EXPONENT_SIGMA, EXPONENT_REF = 4.1, 0.4, 3.0
