"""Scenario, index, mechanism and code tables that results depend on."""

from __future__ import annotations

EXPOSURE_INDICES = [
    "remote_work_exposure_index",
    "in_person_work_exposure_index",
    "digital_distraction_index",
    "digital_social_index",
    "in_person_social_index",
    "digital_access_index",
    "digital_use_prevalence_index",
    "commute_burden_index",
    "work_family_compatibility_proxy",
    "gendered_care_risk_proxy",
]

# Components and weights per index.
INDEX_COMPONENTS = {
    "remote_work_exposure_index": [
        ("remote_work_share_state_year", 1.0),
        ("remote_work_time_saved_roundtrip_minutes_state_year", 1.0),
        ("work_at_home_minutes_state_year", 0.5),
        ("telework_hours_mean_among_remote", 0.5),
    ],
    "in_person_work_exposure_index": [
        ("on_site_work_share", 1.0),
        ("work_away_minutes_state_year", 0.75),
        ("commuting_minutes_state_year", 0.75),
        ("mean_commute_minutes_state_year", 0.5),
        ("long_commute_share_state_year", 0.75),
    ],
    "digital_distraction_index": [
        ("screen_leisure_minutes_broad_state_year", 1.0),
        ("digital_media_minutes_narrow_state_year", 0.75),
    ],
    "digital_social_index": [
        ("digital_social_proxy_value", 0.75),
        ("search_interest_online_dating_state_year", 1.0),
        ("internet_use_rate_state_year", 0.5),
    ],
    "in_person_social_index": [
        ("in_person_social_minutes_state_year", 1.0),
        ("face_to_face_social_minutes_state_year", 0.5),
        ("time_with_friends_minutes_state_year", 0.5),
    ],
    "digital_access_index": [
        ("digital_access_index_raw", 1.0),
        ("broadband_subscription_rate", 0.75),
        ("smartphone_or_computer_access_rate", 0.75),
        ("no_internet_rate_inverse", 0.5),
    ],
    "digital_use_prevalence_index": [
        ("internet_use_rate_state_year", 1.0),
        ("mobile_device_use_rate_state_year", 0.75),
        ("online_activity_index_state_year", 0.75),
        ("digital_access_gap_state_year_inverse", 0.5),
    ],
    "commute_burden_index": [
        ("mean_commute_minutes_state_year", 1.0),
        ("long_commute_share_state_year", 1.0),
        ("commuting_minutes_state_year", 0.75),
        ("work_away_minutes_state_year", 0.5),
    ],
    "work_family_compatibility_proxy": [
        ("remote_work_time_saved_roundtrip_minutes_state_year", 1.0),
        ("remote_work_share_state_year", 0.75),
        ("work_at_home_minutes_state_year", 0.5),
        ("care_burden_minutes_state_year_inverse", 0.5),
    ],
    "gendered_care_risk_proxy": [
        ("remote_work_share_state_year", 0.75),
        ("female_employment_rate", 0.75),
        ("care_burden_minutes_state_year", 1.0),
        ("unpaid_care_minutes_state_year", 0.75),
        ("household_work_minutes_state_year", 0.5),
    ],
}

# Scenario labels and yearly increments of the index columns.
SCENARIOS = {
    "baseline_continuation": ("Scenario 1: Baseline continuation", {}),
    "distraction_dominant": (
        "Scenario 2: Distraction-dominant digital life",
        {
            "digital_distraction_index": 0.04,
            "digital_social_index": 0.01,
            "in_person_social_index": -0.02,
            "remote_work_exposure_index": 0.002,
        },
    ),
    "remote_work_dominant": (
        "Scenario 3: Remote-work dominant digital life",
        {
            "remote_work_exposure_index": 0.03,
            "commute_burden_index": -0.02,
            "digital_distraction_index": 0.005,
            "work_family_compatibility_proxy": 0.02,
        },
    ),
    "digital_social_substitution": (
        "Scenario 4: Digital-social substitution",
        {"digital_social_index": 0.03, "in_person_social_index": -0.015, "digital_distraction_index": 0.01},
    ),
    "in_person_revival": (
        "Scenario 5: In-person revival",
        {
            "in_person_social_index": 0.025,
            "in_person_work_exposure_index": 0.015,
            "digital_distraction_index": -0.01,
            "remote_work_exposure_index": 0.005,
        },
    ),
    "gendered_care_penalty": (
        "Scenario 6: Gendered-care penalty",
        {
            "remote_work_exposure_index": 0.02,
            "work_family_compatibility_proxy": 0.01,
            "gendered_care_risk_proxy": 0.025,
        },
    ),
    "user_defined": ("Scenario 7: User-defined scenario", {}),
}

# Yearly increments of the measured columns per scenario.
MEASURE_INCREMENTS = {
    "baseline_continuation": {},
    "distraction_dominant": {
        "screen_leisure_minutes_broad_state_year": 3.0,
        "digital_media_minutes_narrow_state_year": 1.25,
        "in_person_social_minutes_state_year": -1.5,
    },
    "remote_work_dominant": {
        "remote_work_share_state_year": 0.004,
        "digital_media_minutes_narrow_state_year": 0.2,
        "screen_leisure_minutes_broad_state_year": 0.5,
        "in_person_social_minutes_state_year": 0.25,
    },
    "digital_social_substitution": {
        "digital_media_minutes_narrow_state_year": 0.75,
        "screen_leisure_minutes_broad_state_year": 1.0,
        "in_person_social_minutes_state_year": -0.5,
        "search_interest_online_dating_state_year": 0.5,
    },
    "in_person_revival": {
        "screen_leisure_minutes_broad_state_year": -1.5,
        "digital_media_minutes_narrow_state_year": -0.5,
        "in_person_social_minutes_state_year": 2.0,
    },
    "gendered_care_penalty": {
        "remote_work_share_state_year": 0.0025,
        "household_work_minutes_state_year": 1.5,
        "unpaid_care_minutes_state_year": 1.5,
        "screen_leisure_minutes_broad_state_year": 0.5,
    },
    "user_defined": {},
}

# User-facing parameter names and the index column each one moves.
USER_PARAMETERS = {
    "remote_work_exposure": "remote_work_exposure_index",
    "digital_distraction": "digital_distraction_index",
    "digital_social_exposure": "digital_social_index",
    "in_person_work": "in_person_work_exposure_index",
    "in_person_social_interaction": "in_person_social_index",
    "commute_burden": "commute_burden_index",
    "work_family_compatibility": "work_family_compatibility_proxy",
    "gendered_care_penalty": "gendered_care_risk_proxy",
}

# Default parameters of the rate projection.
PARAMETERS = {
    "digital_distraction_growth": 0.02,
    "remote_work_growth": 0.01,
    "face_to_face_change": -0.01,
    "digital_social_growth": 0.005,
    "fertility_effect_distraction_per_hour": -0.04,
    "fertility_effect_social_per_hour": 0.02,
    "fertility_effect_remote_per_10pp": 0.03,
    "gendered_care_penalty": 0.015,
    "projection_horizon": 2030,
    "uncertainty_multiplier_low": 0.5,
    "uncertainty_multiplier_mid": 1.0,
    "uncertainty_multiplier_high": 1.5,
}

# Terms of the relative rate change by scenario code: (code, parameter, parameter or None, scale, weight);
# the scale turns an effect per ten points into one per unit.
FACTOR_TERMS = [
    ("A", "digital_distraction_growth", "fertility_effect_distraction_per_hour", 1.0, 1.0),
    ("A", "face_to_face_change", "fertility_effect_social_per_hour", 1.0, 0.5),
    ("B", "digital_social_growth", "fertility_effect_social_per_hour", 1.0, 1.0),
    ("B", "digital_distraction_growth", "fertility_effect_distraction_per_hour", 1.0, 0.25),
    ("C", "remote_work_growth", "fertility_effect_remote_per_10pp", 10.0, 1.0),
    ("C", "digital_social_growth", "fertility_effect_social_per_hour", 1.0, 0.25),
    ("D", "remote_work_growth", "fertility_effect_remote_per_10pp", 10.0, 1.0),
    ("D", "gendered_care_penalty", None, 1.0, -1.0),
    ("D", "digital_distraction_growth", "fertility_effect_distraction_per_hour", 1.0, 1.0),
    ("E", "remote_work_growth", "fertility_effect_remote_per_10pp", 10.0, 0.65),
    ("E", "digital_social_growth", "fertility_effect_social_per_hour", 1.0, 0.35),
    ("E", "gendered_care_penalty", None, 1.0, -0.25),
]

# Decay, bounds, tolerances, anchors, thresholds.
OVERRIDE_DECAY = 0.92
SHARE_EPSILON = 1e-4
FORECAST_FLOOR = 5.0
FORECAST_CEILING = 150.0
BOUND_SLACK = 1e-3
HEAVY_BOUND_SHARE = 0.25
CAUTION_BOUND_SHARE = 0.20
DIFFERENCE_TOLERANCE = {"state": 0.05, "msa": 0.005}
COMMUTE_ANCHOR = 25.0
MIN_ENTITY_SAMPLE = 150
DEFAULT_DEATH_RATE = 0.008
FORECAST_END = 2060
MIN_DOMAIN_SPAN = 0.001
DOMAIN_PADDING = 0.001

# Five-year bands and their widths.
BAND_WIDTHS = {"15-19": 5, "20-24": 5, "25-29": 5, "30-34": 5, "35-39": 5, "40-44": 5}

# Age groups, closed ranges.
AGE_GROUPS = [(15, 24, "15-24"), (25, 34, "25-34"), (35, 44, "35-44"), (45, 54, "45-54")]

# Activity code classes.
ACTIVITY_PREFIXES = {"is_socializing": ["1201", "1202"], "is_work": ["05"], "is_commuting": ["1805"]}
ACTIVITY_EXACT = {"is_digital_media_narrow": ["120308"], "is_screen_leisure_broad": ["120303", "120307", "120308"]}
ACTIVITY_TIERS = {"is_household_work": ["02"], "is_unpaid_care": ["03", "04"]}
AT_HOME_PLACES = [1]

# Mechanism columns and their labels.
MECHANISMS = {
    "mechanism_remote_work_flexibility": "remote-work time saved",
    "mechanism_digital_distraction": "screen leisure",
    "mechanism_online_matching": "online matching / digital social life",
    "mechanism_in_person_social": "in-person social interaction",
    "mechanism_care_burden": "care burden",
}

# Public scenario ids by source scenario.
PUBLIC_SCENARIOS = {
    "baseline_continuation": "reference_path",
    "remote_work_dominant": "remote_work_saves_time",
    "distraction_dominant": "digital_distraction_crowds_out",
    "digital_social_substitution": "online_life_helps_matching",
    "gendered_care_penalty": "home_centered_digital_life_increases_care_work",
}
SCENARIO_ALIASES = {"remote_work_increases_care_burden": "home_centered_digital_life_increases_care_work"}

# Fixed values: (scenario, input column, theta, sign, mechanism).
REMOTE_BETA = 0.256923795041114
ADJUSTMENT_TERMS = [
    ("digital_distraction_crowds_out", "screen_leisure_minutes_broad_state_year", 0.24, -1.0, "mechanism_digital_distraction"),
    ("digital_distraction_crowds_out", "digital_media_minutes_narrow_state_year", 0.10, -1.0, "mechanism_digital_distraction"),
    ("digital_distraction_crowds_out", "in_person_social_minutes_state_year", 0.12, 1.0, "mechanism_in_person_social"),
    ("online_life_helps_matching", "search_interest_online_dating_state_year", 0.35, 1.0, "mechanism_online_matching"),
    ("home_centered_digital_life_increases_care_work", "care_burden_minutes_state_year", 0.20, -1.0, "mechanism_care_burden"),
    ("home_centered_digital_life_increases_care_work", "screen_leisure_minutes_broad_state_year", 0.05, -1.0, "mechanism_care_burden"),
    ("home_centered_digital_life_increases_care_work", "remote_work_share_state_year", 0.05, 1.0, "mechanism_remote_work_flexibility"),
]

# Mechanism weights of the slider adjustment, per scenario.
SLIDER_PROFILES = {
    "remote_work_saves_time": {"remote": 1.0, "distraction": 0.35, "online": 0.2, "inPerson": 0.25, "care": 0.6},
    "digital_distraction_crowds_out": {"remote": 0.1, "distraction": 1.0, "online": 0.2, "inPerson": 0.45, "care": 0.15},
    "online_life_helps_matching": {"remote": 0.15, "distraction": 0.25, "online": 1.0, "inPerson": 0.2, "care": 0.1},
    "home_centered_digital_life_increases_care_work": {"remote": 0.25, "distraction": 0.15, "online": 0.05, "inPerson": 0.05, "care": 1.1},
}
# Births per unit of slider movement, and the entity's sensitivity as base plus slope times a measure (capped).
SLIDER_EFFECTS = [
    # slider, births per unit, base, slope, measure, cap
    ("remote", 44.0, 1.0, 4.0, "share", None),
    ("distraction", -34.0, 1.0, 0.005, "genai", None),
    ("online", 28.0, 0.9, 0.005, "dating", None),
    ("inPerson", 26.0, 0.9, 18.0, "growth", 0.5),
    ("care", -40.0, 1.0, 3.0, "share", None),
]
# Mechanism score per unit of slider movement, the slope of its sensitivity to the share, and the slider whose
# scenario weight applies.
SLIDER_MOVES = [
    # mechanism, weighted by, slider, score per unit, slope
    ("mechanism_remote_work_flexibility", "remote", "remote", 15.0, 3.0),
    ("mechanism_remote_work_flexibility", "remote", "inPerson", 8.0, 0.0),
    ("mechanism_digital_distraction", "distraction", "distraction", -14.0, 0.0),
    ("mechanism_online_matching", "online", "online", 12.0, 0.0),
    ("mechanism_in_person_social", "inPerson", "inPerson", 11.0, 0.0),
    ("mechanism_in_person_social", "inPerson", "distraction", -3.0, 0.0),
    ("mechanism_care_burden", "care", "care", -16.0, 0.0),
    ("mechanism_care_burden", "care", "remote", -4.0, 0.0),
]
SLIDER_NEUTRAL = {"remote": 1.0, "distraction": 1.0, "online": 1.0, "inPerson": 1.0, "care": 1.0}

# Which ranks feed which scale, and the scale's range (default 0.7 to 1.3).
SCALE_COMPONENTS = {
    "remote_readiness": (["remote_work_exposure_index"], [], 0.7, 1.3),
    "commute_relief": (["commute_burden_index", "in_person_work_exposure_index", "population_growth_rate"], [], 0.7, 1.3),
    "flexibility_gain": (
        ["remote_work_exposure_index", "work_family_compatibility_proxy"], ["work_family_compatibility_proxy"], 0.7, 1.3,
    ),
    "distraction_intensity": (["digital_distraction_index"], [], 0.8, 1.25),
    "online_matching": (["digital_social_index", "married_or_partnered_share_state_year"], [], 0.8, 1.25),
    "in_person_rebound": (
        ["in_person_social_index", "married_or_partnered_share_state_year", "population_growth_rate"], [], 0.7, 1.3,
    ),
    "care_pressure": (
        ["care_burden_minutes_state_year", "remote_work_share_state_year", "female_employment_rate"], [], 0.7, 1.3,
    ),
}

# The scale that multiplies the increment of each column.
SCALE_OF_COLUMN = {
    "remote_work_exposure_index": "remote_readiness",
    "remote_work_share_state_year": "remote_readiness",
    "in_person_work_exposure_index": "commute_relief",
    "mean_commute_minutes_state_year": "commute_relief",
    "digital_distraction_index": "distraction_intensity",
    "digital_media_minutes_narrow_state_year": "distraction_intensity",
    "screen_leisure_minutes_broad_state_year": "distraction_intensity",
    "digital_social_index": "online_matching",
    "search_interest_online_dating_state_year": "online_matching",
    "in_person_social_index": "in_person_rebound",
    "in_person_social_minutes_state_year": "in_person_rebound",
    "commute_burden_index": "commute_relief",
    "work_family_compatibility_proxy": "flexibility_gain",
    "gendered_care_risk_proxy": "care_pressure",
    "household_work_minutes_state_year": "care_pressure",
    "unpaid_care_minutes_state_year": "care_pressure",
    "care_burden_minutes_state_year": "care_pressure",
}
SCALED_SCENARIOS = [
    "remote_work_dominant",
    "distraction_dominant",
    "digital_social_substitution",
    "in_person_revival",
    "gendered_care_penalty",
]

# Words that decide whether a text means yes or no.
YES_WORDS = ["1", "true", "t", "yes", "y", "remote", "teleworkable", "workfromhome", "workathomefeasible", "workfromhomefeasible"]
NO_WORDS = ["0", "false", "f", "no", "n", "notremote", "nonremote"]
YES_TOKENS = ["telework", "remote", "workfromhome"]

# Notes of the column profile by the end of a column's name.
COLUMN_NOTES = [
    ("_lag1", "lagged feature"),
    ("_lag2", "lagged feature"),
    ("_lag3", "lagged feature"),
    ("_rolling3", "mean of earlier rows"),
    ("_imputed_flag", "marks imputed rows"),
    ("_long_gap_flag", "marks gaps left open"),
]

# Feature families by name prefix.
FEATURE_FAMILIES = [
    ("remote_work_exposure_index", "remote_work"),
    ("digital_distraction_index", "digital_distraction"),
    ("digital_social_index", "digital_social"),
    ("in_person_social_index", "in_person_social"),
    ("in_person_work_exposure_index", "in_person_work"),
    ("fertility_rate_lag", "fertility_lags"),
    ("state_history_", "state_trend_history"),
    ("year_index", "state_trend_history"),
]

# Commuting bin midpoints in minutes by census column.
COMMUTE_MIDPOINTS = {
    "B08303_002E": 2.5,
    "B08303_003E": 7.0,
    "B08303_004E": 12.0,
    "B08303_005E": 17.0,
    "B08303_006E": 22.0,
    "B08303_007E": 27.0,
    "B08303_008E": 32.0,
    "B08303_009E": 37.0,
    "B08303_010E": 42.0,
    "B08303_011E": 52.0,
    "B08303_013E": 74.5,
    "B08303_014E": 95.0,
}

# Modelled adjustment of each time-use metric as weights of z-scores.
TIME_USE_ADJUSTMENTS = {
    "face_to_face_social_minutes": {"attention_z": -6.0, "partnered_z": 4.0},
    "in_person_social_minutes": {"attention_z": -6.0, "partnered_z": 4.0},
    "work_at_home_minutes": {"remote_z": 20.0},
    "work_away_minutes": {"remote_z": -18.0, "commute_z": 6.0},
    "commuting_minutes": {"commute_z": 6.0, "remote_z": -5.0},
    "away_from_home_minutes": {"attention_z": -5.0, "partnered_z": 4.0},
    "household_work_minutes": {"remote_z": 2.0, "partnered_z": 2.0},
    "unpaid_care_minutes": {"remote_z": 3.0, "partnered_z": 2.0},
    "care_burden_minutes": {"remote_z": 5.0, "partnered_z": 4.0},
    "time_alone_minutes": {"attention_z": 8.0},
    "time_with_spouse_only_minutes": {"partnered_z": 3.0, "remote_z": 2.0},
    "time_with_friends_minutes": {"attention_z": -4.0, "partnered_z": 2.0},
    "time_with_nonhousehold_minutes": {"attention_z": -4.0, "partnered_z": 2.0},
    "time_with_family_minutes": {"remote_z": 2.0, "partnered_z": 2.0},
    "time_with_children_minutes": {"remote_z": 3.0, "partnered_z": 2.0},
    "time_with_spouse_minutes": {"partnered_z": 3.0, "remote_z": 1.5},
}
# These three scale the row mean of the attention and prevalence z-scores.
SCREEN_ADJUSTMENTS = {
    "digital_media_minutes_narrow": 6.0,
    "screen_leisure_minutes_broad": 10.0,
    "digital_distraction_minutes": 10.0,
}
