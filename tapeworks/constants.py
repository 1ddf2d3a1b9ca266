"""Fixed values. They are part of the results, so they are listed literally."""

# --- feature names -----------------------------------------------------------
PRICE_FEATURES = [
    "mom_1m", "mom_3m", "mom_6m", "mom_12m",
    "vol_60d", "rsi_14", "price_vs_52w_high",
]
FEATURES = [
    "pe_ratio", "forward_pe", "pb_ratio", "roe", "net_margin", "fcf_yield",
    "ev_ebitda", "revenue_growth", "debt_equity", "dividend_yield",
    "mom_1m", "mom_3m", "mom_6m", "mom_12m", "vol_60d", "beta", "log_mktcap",
    "rsi_14", "price_vs_52w_high", "earnings_surprise", "analyst_consensus",
]
MOMENTUM_BARS = {"mom_1m": 21, "mom_3m": 63, "mom_6m": 126, "mom_12m": 252}
BASE_CHANNELS = ["logret", "vol"]
MARKET_CHANNELS = ["rel_volume", "log_dollar_vol", "excess_ret_vs_market", "rel_strength_vs_sector"]
EVENT_CHANNELS = ["earn_surprise_pulse", "analyst_net_buy_ts"]
CANDIDATE_BARS = 60
CANDIDATE_NAMES = 10

# --- calendars, horizons, costs ----------------------------------------------
BARS_PER_MONTH = 21
BARS_PER_YEAR = 252
LABEL_HORIZONS = [63, 126, 252]
RISK_FREE = 0.045
COST_BPS = 30

# --- symbols -----------------------------------------------------------------
TICKER_PATTERN = r"^(?=[A-Z0-9.\-]*[A-Z])[A-Z0-9.\-]{1,15}$"
ACCEPTED_TYPES = {
    "stock": ["Common Stock"],
    "etf": ["ETP", "ETF"],
    "all": ["Common Stock", "ETP", "ETF", "ADR"],
}

# --- signal rules ------------------------------------------------------------
THRESHOLDS = {"strong_buy": 0.68, "buy": 0.54, "hold": 0.38}
THRESHOLD_PERCENTILES = {"strong_buy": 0.80, "buy": 0.55, "hold": 0.30}
STABILITY_NOTE = (
    "Sitting near a signal threshold — small moves may flip this. "
    "Avoid acting on short-term noise."
)
ACTION_NOTES = {
    "STRONG BUY": "Strong conviction buy candidate.",
    "BUY": "Buy candidate.",
    "HOLD": "Hold — no action needed. Not a fresh buy, but no reason to sell on this alone.",
    "SELL": "Model does not favour this. Review the bear case before holding.",
}
BANDS = [("High", 70.0), ("Moderate", 55.0), ("Low", 38.0), ("Bearish", None)]

# Reasons: (column, above, below, factor for the text, text). A rule fires when the
# value is known, not zero, above the first and below the second bound. "ratings"
# stands for the share of buy (bull) or sell (bear) ratings out of at least three.
BULL_RULES = [
    ("pe_ratio", None, 18, 1, "Attractive valuation at P/E {:.1f}x — below market average"),
    ("ev_ebitda", 0, 12, 1, "Cheap at {:.1f}x EV/EBITDA — strong value across the capital structure"),
    ("roe", 0.20, None, 100, "Strong ROE of {:.0f}% — durable competitive advantage"),
    ("fcf_yield", 0.04, None, 100, "FCF yield of {:.1f}% — real cash generation backing the valuation"),
    ("net_margin", 0.15, None, 100, "High net margin of {:.1f}% — pricing power and scalability"),
    ("debt_equity", None, 0.5, 1, "Conservative balance sheet at {:.2f}x D/E — financial flexibility"),
    ("revenue_growth", 0.12, None, 100, "Revenue growing at {:.0f}% — compounding top-line momentum"),
    ("mom_12m", 0.15, None, 100, "Strong 12M momentum (+{:.0f}%)"),
    ("earnings_surprise", 0.15, None, 1, "Consistently beating earnings estimates — analyst upgrades likely to follow"),
    ("dividend_yield", 0.03, None, 100, "Dividend yield of {:.1f}% — income with quality backing"),
    ("ratings", 0.65, None, 1, "{} of {} analysts rate BUY — broad professional conviction"),
    ("inst_ownership", 0.70, None, 100, "{:.0f}% institutional ownership — strong professional conviction"),
    ("insider_ownership", 0.10, None, 100, "Insiders hold {:.0f}% — management aligned with shareholders"),
]
BEAR_RULES = [
    ("pe_ratio", 50, None, 1, "Stretched P/E of {:.0f}x requires perfect execution"),
    ("ev_ebitda", 25, None, 1, "Premium at {:.1f}x EV/EBITDA — limited margin of safety on cash earnings"),
    ("mom_12m", None, -0.08, 100, "Negative 12M trend ({:.0f}%) — market expressing concern"),
    ("debt_equity", 2.0, None, 1, "High leverage at {:.2f}x D/E — elevated refinancing risk"),
    ("revenue_growth", None, 0, 100, "Declining revenues ({:.0f}%) — structural headwinds"),
    ("net_margin", None, 0.05, 100, "Very thin margins ({:.1f}%) — limited operational resilience"),
    ("fcf_yield", None, 0, 1, "Negative free cash flow — earnings quality is low; reliant on external financing"),
    ("earnings_surprise", None, -0.15, 1, "Consistently missing earnings estimates — confidence in forward guidance is low"),
    ("ratings", 0.30, None, 1, "{} of {} analysts rate SELL — notable professional skepticism"),
    ("inst_ownership", None, 0.30, 100, "Low institutional interest ({:.0f}%) — limited professional coverage"),
]
HYSTERESIS_NOTES = {
    "softened": "You rated this a BUY{when}. The score has softened but hasn't broken "
                "down — consider holding rather than selling on this move.",
    "intact": "You flagged this BUY{when}; now HOLD — thesis intact, no action needed.",
    "broken": "Was a BUY{when}; the score has since deteriorated materially — the "
              "thesis has weakened.",
}
BETA_NOTE = "vs S&P 500 — may not reflect local market beta"

# --- profile weights ---------------------------------------------------------
PROFILE_COLUMNS = ["pe", "pb", "roe", "de", "dy", "rg", "mg", "m12", "m3"]
PROFILE_WEIGHTS = {
    "value": [-0.28, -0.20, 0.25, -0.15, 0.06, 0.04, 0.10, 0.04, 0.0],
    "growth": [-0.04, -0.04, 0.15, -0.05, -0.06, 0.42, 0.20, 0.14, 0.10],
    "dividend": [-0.10, -0.10, 0.20, -0.15, 0.38, 0.04, 0.10, 0.04, 0.0],
    "momentum": [0.0, 0.0, 0.05, -0.05, 0.0, 0.10, 0.04, 0.48, 0.32],
    "quality": [-0.15, -0.10, 0.30, -0.15, 0.05, 0.15, 0.22, 0.05, 0.0],
    "macro": [-0.12, -0.08, 0.18, -0.20, 0.10, 0.15, 0.12, 0.12, 0.08],
    "activist": [-0.35, -0.30, 0.15, -0.10, 0.08, 0.02, 0.08, -0.04, -0.02],
}
RISK_BETA = {"low": (0.35, 0.8), "medium": (0.10, 1.5), "high": (0.0, 99.0)}

# --- sectors -----------------------------------------------------------------
SECTORS = [
    "Technology", "Communication Services", "Healthcare", "Financials",
    "Consumer Discretionary", "Consumer Staples", "Industrials", "Energy",
    "Utilities", "Materials", "Real Estate",
]
CORE_SECTORS = ["Technology", "Healthcare", "Financials", "Consumer Staples", "Industrials"]
OVER_CONCENTRATION_PCT = 40.0
OVER_MESSAGE = "{pct}% of your portfolio is in {sector} — heavy single-sector concentration raises your risk."
GAP_MESSAGE = "No {sector} exposure — a core sector most balanced portfolios hold."

EXACT_SECTORS = {
    "technology": "Technology",
    "communication services": "Communication Services",
    "healthcare": "Healthcare",
    "financial services": "Financials",
    "consumer cyclical": "Consumer Discretionary",
    "consumer defensive": "Consumer Staples",
    "industrials": "Industrials",
    "energy": "Energy",
    "utilities": "Utilities",
    "basic materials": "Materials",
    "real estate": "Real Estate",
}
# First match wins, so the order is part of the value.
SECTOR_KEYWORDS = [
    ("real estate", "Real Estate"), ("reit", "Real Estate"),
    ("semiconduct", "Technology"), ("software", "Technology"),
    ("technology", "Technology"), ("hardware", "Technology"),
    ("electronic", "Technology"),
    ("telecom", "Communication Services"), ("media", "Communication Services"),
    ("communication", "Communication Services"), ("entertain", "Communication Services"),
    ("interactive", "Communication Services"),
    ("pharma", "Healthcare"), ("biotech", "Healthcare"), ("health", "Healthcare"),
    ("medical", "Healthcare"), ("drug", "Healthcare"), ("life science", "Healthcare"),
    ("bank", "Financials"), ("insur", "Financials"), ("financ", "Financials"),
    ("capital market", "Financials"), ("asset manage", "Financials"), ("payment", "Financials"),
    ("oil", "Energy"), ("gas", "Energy"), ("petroleum", "Energy"), ("energy", "Energy"),
    ("utilit", "Utilities"), ("electric util", "Utilities"), ("water util", "Utilities"),
    ("chemical", "Materials"), ("metal", "Materials"), ("mining", "Materials"),
    ("steel", "Materials"), ("material", "Materials"), ("paper", "Materials"),
    ("aerospace", "Industrials"), ("defense", "Industrials"), ("machinery", "Industrials"),
    ("airline", "Industrials"), ("transport", "Industrials"), ("logistic", "Industrials"),
    ("construction", "Industrials"), ("industrial", "Industrials"),
    ("food", "Consumer Staples"), ("beverage", "Consumer Staples"),
    ("tobacco", "Consumer Staples"), ("household", "Consumer Staples"),
    ("grocery", "Consumer Staples"), ("staple", "Consumer Staples"),
    ("retail", "Consumer Discretionary"), ("auto", "Consumer Discretionary"),
    ("apparel", "Consumer Discretionary"), ("leisure", "Consumer Discretionary"),
    ("hotel", "Consumer Discretionary"), ("restaurant", "Consumer Discretionary"),
    ("travel", "Consumer Discretionary"), ("discretionary", "Consumer Discretionary"),
    ("cyclical", "Consumer Discretionary"),
]
# Vendor industry -> sector benchmark symbol; first contains-match wins.
SECTOR_BENCHMARKS = {
    "Technology": "XLK", "Communications": "XLC", "Media": "XLC",
    "Telecommunication": "XLC", "Financial Services": "XLF", "Banking": "XLF",
    "Insurance": "XLF", "Health Care": "XLV", "Healthcare": "XLV",
    "Pharmaceuticals": "XLV", "Biotechnology": "XLV", "Energy": "XLE",
    "Oil & Gas": "XLE", "Industrials": "XLI", "Machinery": "XLI",
    "Aerospace & Defense": "XLI", "Consumer Discretionary": "XLY",
    "Retail": "XLY", "Automobiles": "XLY", "Consumer Staples": "XLP",
    "Food Products": "XLP", "Beverages": "XLP", "Consumer products": "XLP",
    "Utilities": "XLU", "Real Estate": "XLRE", "Basic Materials": "XLB",
    "Materials": "XLB", "Chemicals": "XLB",
}

# --- event channels ----------------------------------------------------------
ANNOUNCE_LAG_DAYS = 45
PULSE_DECAY_DAYS = 21.0
PULSE_MAX_AGE_DAYS = 63

# --- monitoring --------------------------------------------------------------
PSI_WARNING = 0.10
PSI_CRITICAL = 0.25
PSI_BINS = 10
PSI_EPS = 1e-6
IC_WARNING_RATIO = 0.70
IC_CRITICAL_RATIO = 0.50
IC_RETRAIN_RUN = 3
IC_WINDOWS = [20, 60, 120]
IC_PRIMARY_WINDOW = 60
LABEL_HORIZON_BARS = 252
CALENDAR_DAYS_PER_BAR = 1.45
RETENTION_DAYS = 730
ACTIVITY_RETENTION_DAYS = 90
PRICE_TTL_HOURS = 168
SNAPSHOT_TTL_HOURS = 24
MAX_PRIOR_EVENTS = 60

# --- minimum history ---------------------------------------------------------
MIN_BARS_FETCH = 60
MIN_BARS_PANEL = 30
MIN_PANEL_NAMES = 20
MIN_TRAIN_ROWS = 60
