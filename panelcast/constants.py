"""Model defaults and fixed numeric values.

FIXED VALUES — these must equal the published model definitions so that
forecasts reproduce the stored golden predictions. They are stated here
plainly, together, in the order the models define them.
"""

# --- fixed values: saturation-curve model (logistic_price) -----------------
LOGISTIC_PRICE_DEFAULTS = {
    "k1": -6.59917386,
    "k2": 0.39546328,
    "distribution_a": 1.1572,
    "distribution_b": 4.3517429,
    "full_price_scale": 30.0,
    "full_penetration": 0.8193343775346827,
    "optimize_parameters": False,
    "apply_continuity_adjustment": True,
    "monte_carlo_simulations": 0,
}

# --- fixed values: linear price model (linear_price) -----------------------
LINEAR_PRICE_DEFAULTS = {"C1": -0.5, "C2": 0.5, "optimize_parameters": False}

# --- fixed values: linear income-index model (linear_income_index) ---------
LINEAR_INCOME_INDEX_DEFAULTS = {"C1": -0.5, "C2": 0.5, "optimize_parameters": False}

# --- fixed values: implied-price model (implied_price_logistic) ------------
IMPLIED_PRICE_DEFAULTS = {
    "k1": -6.59917386,
    "k2": 0.39546328,
    "distribution_a": 1.1572,
    "distribution_b": 4.3517429,
    "ref_year": 0,
    "ref_gdp_per_capita": 0.0,
    "ref_normalized_traffic": 0.0,
    "ref_elasticity": -1.728566864526717,
    "fare_growth_rate": 0.0,
    "optimize_parameters": False,
}

# --- fixed values: trend/elasticity blend (trend_elasticity_blend) ---------
BLEND_DEFAULTS = {"trend_weight": 0.5, "optimize_parameters": False}

# --- fixed values: bootstrap model (bootstrap_logistic) --------------------
BOOTSTRAP_DEFAULTS = {
    "k1": -6.59917386,
    "k2": 0.39546328,
    "distribution_a": 1.1572,
    "distribution_b": 4.3517429,
    "optimize_parameters": False,
    "n_simulations": 1000,
    "apply_continuity_adjustment": True,
    "seed": 42,
}

# --- fixed values: driver growth per year (gdp per head, population, price) -
DEFAULT_GDP_GROWTH = 0.03
DEFAULT_POP_GROWTH = 0.01
DEFAULT_PRICE_INFLATION = 0.02

# --- fixed values: bands, clips and guards ---------------------------------
BAND_LOW = 0.8
BAND_HIGH = 1.2
BAND_Z = 1.96
INDEX_CLIP_LOW = 0.2
INDEX_CLIP_HIGH = 3.0
RECENT_SHARE = 0.2          # recent-window continuity: max(3, floor(0.2 n)) years
RECENT_MIN_YEARS = 3
MAPE_EPS = 1e-10

# --- fixed values: threshold bisection -------------------------------------
BISECT_LO = 1e-6
BISECT_HI = 10.0
BISECT_GROW = 1.5
BISECT_EXPAND_STEPS = 60
BISECT_TOL = 1e-12
BISECT_MAX_STEPS = 200

# --- fixed values: bootstrap grid (k1 outer, k2 inner) ---------------------
BOOT_K1_LO, BOOT_K1_HI, BOOT_K1_N = -20.0, 20.0, 41
BOOT_K2_LO, BOOT_K2_HI, BOOT_K2_N = 0.05, 5.0, 30

# --- fixed values: calibration box of the saturation curve -----------------
CALIB_K1_LO, CALIB_K1_HI = -20.0, 20.0
CALIB_K2_LO, CALIB_K2_HI = 0.01, 5.0

# --- fixed values: column-name synonyms (normalised name -> canonical) -----
COLUMN_SYNONYMS = {
    "annee": "year", "date": "year", "t": "year",
    "passagers": "actual_passengers", "passengers": "actual_passengers",
    "traffic": "actual_passengers", "volume": "actual_passengers", "y": "actual_passengers",
    "population": "population", "pop": "population", "pop_total": "population",
    "gdp": "gdp_per_capita", "pib": "gdp_per_capita", "income": "gdp_per_capita",
    "price": "ticket_price", "prix": "ticket_price", "fare": "ticket_price",
}

# Canonical long names of the file layer -> short panel names.
LONG_TO_PANEL = {
    "actual_passengers": "actual",
    "gdp_per_capita": "gdp",
    "ticket_price": "price",
}

# --- fixed values: required columns per model (file-layer names) -----------
MODEL_REQUIREMENTS = {
    "logistic_price": ["actual_passengers", "gdp_per_capita", "population", "ticket_price"],
    "linear_price": ["actual_passengers", "gdp_per_capita", "population", "ticket_price"],
    "trend_elasticity_blend": ["actual_passengers", "gdp_per_capita", "population", "ticket_price"],
    "linear_income_index": ["actual_passengers", "gdp_per_capita", "population"],
    "implied_price_logistic": ["actual_passengers", "gdp_per_capita", "population"],
    "bootstrap_logistic": ["actual_passengers", "gdp_per_capita", "population", "ticket_price"],
}

MODEL_NAMES = [
    "logistic_price",
    "linear_price",
    "linear_income_index",
    "implied_price_logistic",
    "trend_elasticity_blend",
    "bootstrap_logistic",
]
