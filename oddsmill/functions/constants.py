"""Word lists, codes, limits and tables that results depend on."""

# Probability columns, one per expert. Null means the expert did not score the row.
EXPERTS = ["p_forecast_cal", "p_nn", "p_tabdl", "p_lr", "p_xgb", "p_lgbm"]

# Generational suffixes dropped from the end of a name.
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]

# Name overrides, already in normalised form on both sides.
NAME_OVERRIDES = {
    "tristan silva": "tristan da silva",
    "yanic niederhauser": "yanic konan niederhauser",
}

# Team code overrides.
TEAM_OVERRIDES = {
    "BRK": "BKN", "BK": "BKN", "NJN": "BKN", "PHO": "PHX", "NO": "NOP", "NOK": "NOP", "NY": "NYK",
    "SA": "SAS", "GS": "GSW", "WSH": "WAS", "CHO": "CHA", "MINN": "MIN", "UTAH": "UTA",
}
MARKET_TEAM_OVERRIDES = {"GS": "GSW", "NO": "NOP", "SA": "SAS", "NY": "NYK", "UTAH": "UTA", "WSH": "WAS"}

# Home venues: latitude, longitude, standard-time UTC offset in hours.
TEAM_GEO = {
    "ATL": (33.76, -84.39, -5.0), "BOS": (42.36, -71.06, -5.0), "BKN": (40.68, -73.98, -5.0),
    "CHA": (35.23, -80.84, -5.0), "CHI": (41.88, -87.63, -6.0), "CLE": (41.50, -81.69, -5.0),
    "DAL": (32.78, -96.80, -6.0), "DEN": (39.74, -104.99, -7.0), "DET": (42.33, -83.05, -5.0),
    "GSW": (37.77, -122.42, -8.0), "HOU": (29.76, -95.37, -6.0), "IND": (39.77, -86.16, -5.0),
    "LAC": (34.05, -118.24, -8.0), "LAL": (34.05, -118.24, -8.0), "MEM": (35.15, -90.05, -6.0),
    "MIA": (25.76, -80.19, -5.0), "MIL": (43.04, -87.91, -6.0), "MIN": (44.98, -93.27, -6.0),
    "NOP": (29.95, -90.07, -6.0), "NYK": (40.75, -73.99, -5.0), "OKC": (35.47, -97.52, -6.0),
    "ORL": (28.54, -81.38, -5.0), "PHI": (39.95, -75.17, -5.0), "PHX": (33.45, -112.07, -7.0),
    "POR": (45.52, -122.68, -8.0), "SAC": (38.58, -121.49, -8.0), "SAS": (29.42, -98.49, -6.0),
    "TOR": (43.65, -79.38, -5.0), "UTA": (40.76, -111.89, -7.0), "WAS": (38.91, -77.04, -5.0),
}
TEAMS = sorted(TEAM_GEO)

# Odds codes of a line; only code 0 is eligible.
ODDS_CODES = {"standard": 0, "goblin": 1, "demon": 2}

# Games of league-mean weight used when a short history is regressed.
STABILIZATION_GAMES = {
    "Points": 10.0, "Rebounds": 12.0, "Assists": 12.0, "Steals": 20.0, "Blocked Shots": 20.0,
    "Turnovers": 12.0, "3-PT Made": 18.0, "3-PT Attempted": 18.0, "FG Made": 10.0, "FG Attempted": 10.0,
    "Free Throws Made": 8.0, "Free Throws Attempted": 8.0, "Pts+Rebs": 10.0, "Pts+Asts": 10.0,
    "Rebs+Asts": 10.0, "Pts+Rebs+Asts": 10.0, "Blks+Stls": 20.0, "Two Pointers Made": 12.0,
    "Two Pointers Attempted": 12.0, "Fantasy Score": 10.0, "Dunks": 30.0,
}
DEFAULT_STABILIZATION = 10.0

# Slate scoring rules.
EXCLUDED_STATS = ["Dunks", "Blocked Shots"]
PRIOR_ONLY_STATS = ["Offensive Rebounds", "Two Pointers Made", "Turnovers", "Blks+Stls"]
CALIBRATION_EXCLUDED_STATS = [
    "Dunks", "Blocked Shots", "Blks+Stls", "Offensive Rebounds", "Personal Fouls", "Steals",
]
SHRINK_MIN, SHRINK_MAX, SHRINK_ANCHOR = 0.05, 0.25, 0.5
EXPERT_FLOOR, EXPERT_CEIL = 0.25, 0.75
PICK_THRESHOLD = 0.60
PUBLISH_THRESHOLD = 0.57
CONFORMAL_PENALTY = 0.02
MIN_EDGE, MIN_NEFF, MAX_FORECAST_EDGE, MIN_SPREAD = 5.0, 10.0, 4.0, 0.10
TOP_SHARE, TOP_SHARE_RELAXED, MIN_RETURN_RATIO = 0.70, 0.80, 0.75
IMBALANCE_THRESHOLD, MAX_IMBALANCE_PENALTY = 0.75, 12.0

# Context priors.
PRIOR_FLOOR, PRIOR_CEILING, PRIOR_CENTER_WEIGHT, MIN_BUCKET_ROWS = 0.42, 0.58, 0.6, 30

# Online weights.
QUALITY_PRIOR = {"p_lgbm": 0.753, "p_xgb": 0.747, "p_lr": 0.577, "p_nn": 0.554, "p_forecast_cal": 0.511}
WEIGHT_FLOOR, WEIGHT_CAP, ETA, ETA_DECAY, HEDGE_SHRINK = 0.02, 0.45, 0.2, 0.0005, 0.05
