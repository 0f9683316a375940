"""Names, defaults and tables that results must agree with.

Everything in this file is data. The rules that use it live in
``functions`` and ``operators``.
"""

# Columns the models read, in their published order.
EP_FEATURES = [
    "down", "ydstogo", "yardline_100", "half_seconds_remaining",
    "posteam_timeouts_remaining", "defteam_timeouts_remaining",
    "score_differential", "posteam_is_home", "qtr",
    "goal_to_go", "shotgun", "no_huddle",
]
SCORING_FEATURES = [
    "down", "ydstogo", "yardline_100", "half_seconds_remaining",
    "posteam_timeouts_remaining", "defteam_timeouts_remaining",
    "score_differential", "posteam_is_home", "qtr", "goal_to_go",
]
SCORING_TARGETS = [
    "td_prob", "fg_prob", "safety_prob", "no_score_prob",
    "opp_td_prob", "opp_fg_prob", "opp_safety_prob",
]
CLASS_FEATURES = [
    "down", "ydstogo", "yardline_100", "score_differential",
    "qtr", "half_seconds_remaining", "wp",
    "posteam_timeouts_remaining", "defteam_timeouts_remaining",
    "shotgun", "no_huddle", "defenders_in_box", "number_of_pass_rushers",
    "n_rb", "n_te", "n_wr",
    "goal_to_go", "short_yardage", "long_yardage", "red_zone",
    "late_down", "two_minute_drill",
    "heavy_box", "light_box", "extra_rushers",
    "pass_heavy_situation", "run_heavy_situation",
    "heavy_personnel", "spread_personnel",
]
PRESSURE_FEATURES = [
    "down", "ydstogo", "yardline_100", "score_differential",
    "qtr", "half_seconds_remaining", "wp",
    "posteam_timeouts_remaining", "defteam_timeouts_remaining",
    "shotgun", "no_huddle", "defenders_in_box", "number_of_pass_rushers",
    "n_rb", "n_te", "n_wr",
    "blitz", "obvious_passing", "red_zone", "late_game", "rushers_ratio",
]
# The documented input vector of the play classifier.
VECTOR_FEATURES = [
    "down", "ydstogo", "yardline_100", "shotgun", "no_huddle",
    "defenders_in_box", "number_of_pass_rushers", "score_differential",
    "qtr", "half_seconds_remaining",
]
RUN_LABELS = ["inside_run", "outside_run"]
PASS_LABELS = ["deep_pass", "screen", "short_pass"]  # label order is alphabetical

# What an incomplete play is taken to be.
PLAY_DEFAULTS = {
    "down": 1, "ydstogo": 10, "yardline_100": 75, "qtr": 1,
    "half_seconds_remaining": 900, "score_differential": 0, "shotgun": 1,
    "no_huddle": 0, "defenders_in_box": 6, "number_of_pass_rushers": 4,
    "posteam_type": "home", "goal_to_go": 0,
}
# Fills for model inputs (see ``operators.clean.fill_defaults``).
MODEL_FILLS = {
    "goal_to_go": 0, "shotgun": 0, "no_huddle": 0, "half_seconds_remaining": 1800,
    "posteam_timeouts_remaining": 3, "defteam_timeouts_remaining": 3,
    "score_differential": 0, "qtr": 1,
}

# Columns of the streamed, enriched output.
ENRICHED_COLUMNS = [
    "game_id", "play_id", "quarter", "down", "ydstogo",
    "posteam", "defteam", "play_type", "predicted_play_type",
    "pressure_probability", "was_pressure", "time_to_throw",
    "chaos_score", "epa", "processed_at",
]

# Image addresses, keyed by lower-cased team code or player id.
TEAM_LOGO_URL = ("https://a.espncdn.com/i/teamlogos/nfl/500/", ".png")
HEADSHOT_URL = ("https://a.espncdn.com/i/headshots/nfl/players/full/", ".png")

# The 32 teams as (code, name, colour).
TEAMS = [
    ("ARI", "Arizona Cardinals", "97233F"),
    ("ATL", "Atlanta Falcons", "A71930"),
    ("BAL", "Baltimore Ravens", "241773"),
    ("BUF", "Buffalo Bills", "00338D"),
    ("CAR", "Carolina Panthers", "0085CA"),
    ("CHI", "Chicago Bears", "0B162A"),
    ("CIN", "Cincinnati Bengals", "FB4F14"),
    ("CLE", "Cleveland Browns", "311D00"),
    ("DAL", "Dallas Cowboys", "003594"),
    ("DEN", "Denver Broncos", "FB4F14"),
    ("DET", "Detroit Lions", "0076B6"),
    ("GB", "Green Bay Packers", "203731"),
    ("HOU", "Houston Texans", "03202F"),
    ("IND", "Indianapolis Colts", "002C5F"),
    ("JAX", "Jacksonville Jaguars", "006778"),
    ("KC", "Kansas City Chiefs", "E31837"),
    ("LAC", "Los Angeles Chargers", "0080C6"),
    ("LAR", "Los Angeles Rams", "003594"),
    ("LV", "Las Vegas Raiders", "000000"),
    ("MIA", "Miami Dolphins", "008E97"),
    ("MIN", "Minnesota Vikings", "4F2683"),
    ("NE", "New England Patriots", "002244"),
    ("NO", "New Orleans Saints", "D3BC8D"),
    ("NYG", "New York Giants", "0B2265"),
    ("NYJ", "New York Jets", "125740"),
    ("PHI", "Philadelphia Eagles", "004C54"),
    ("PIT", "Pittsburgh Steelers", "FFB612"),
    ("SEA", "Seattle Seahawks", "002244"),
    ("SF", "San Francisco 49ers", "AA0000"),
    ("TB", "Tampa Bay Buccaneers", "D50A0A"),
    ("TEN", "Tennessee Titans", "0C2340"),
    ("WAS", "Washington Commanders", "5A1414"),
]
