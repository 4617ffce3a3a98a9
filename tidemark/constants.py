"""Fixed values the results depend on: thresholds, labels, windows and message texts."""

import datetime as dt

# --- Fixed values: row and period minimums ---------------------------------
MIN_RELIABLE_ROWS = 30
MIN_MODEL_POINTS = 60

# --- Fixed values: text of the reliability messages -------------------------
NO_DATA_TEXT = "No data matches the selected filters%s."
FEW_ROWS_TEXT = (
    "Only %d rows match the selected filters%s. "
    "Statistics and model outputs may be unreliable with fewer than 30 data points. "
    "Consider broadening your date range or removing dimension filters."
)

# --- Fixed values: CRM outcome and stage names -------------------------------
CLOSED_WON = "Closed Won"
CRM_DATE_COLUMNS = ("lead_date", "mql_date", "sql_date", "opportunity_date", "close_date")
FUNNEL_STAGES = ("Lead", "MQL", "SQL", "Opportunity", "Closed Won")

# --- Fixed values: media channels of the mix model ----------------------------
MEDIA_CHANNELS = (
    "Paid Search",
    "Facebook / Instagram",
    "TikTok",
    "Reddit",
    "Display",
    "TV / CTV",
    "Email",
    "Influencer",
)
MIX_DECAY = 0.40
MIX_SATURATION = 5e-5
CALENDAR_TERMS = ("sin_week", "cos_week", "trend")

# --- Fixed values: online promotion windows (first month, day, last month, day, lift)
PROMO_WINDOWS = (
    (2, 10, 2, 14, 1.20),
    (5, 25, 5, 27, 1.25),
    (7, 4, 7, 6, 1.15),
    (11, 25, 11, 30, 1.55),
    (12, 20, 12, 26, 1.45),
    (12, 30, 12, 31, 1.10),
)

# --- Fixed values: offline promotion months (first month, last month, lift) ---
PROMO_MONTHS = (
    (2, 2, 1.12),
    (5, 5, 1.18),
    (7, 7, 1.10),
    (11, 11, 1.40),
    (12, 12, 1.35),
)

# --- Fixed values: deal bands, tiers and the actions drawn from them -----------
SMALL_DEAL_BELOW = 20_000
MID_DEAL_UP_TO = 60_000
HIGH_RISK_FROM = 0.60
MEDIUM_RISK_FROM = 0.30
HIGH_GROWTH_FROM = 75
MODERATE_GROWTH_FROM = 40
CHURN_TRAIN_BEFORE = dt.date(2024, 7, 1)
ACTION_CHURNED = "Re-engage: launch win-back campaign within 30 days"
ACTION_HIGH_RISK = "Urgent: schedule QBR and offer renewal incentive"
ACTION_MEDIUM_HIGH = "Expand: assign dedicated account manager, propose upsell"
ACTION_MEDIUM_MODERATE = "Nurture: increase touchpoint cadence, share case studies"
ACTION_LOW_HIGH = "Scale: prioritise for co-marketing and trade investment"
ACTION_OTHER = "Maintain: monitor quarterly"

# --- Fixed values: monitoring thresholds -----------------------------------------
Z_WARN = 3.0
Z_CRITICAL = 4.5
NULL_WARN = 0.10
NULL_CRITICAL = 0.30
SHIFT_WINDOW = 4
SHIFT_WARN = 0.40
FRESH_WARN_DAYS = 3
FRESH_CRITICAL_DAYS = 7
ROWS_LOOKBACK = 4
ROWS_DROP_WARN = 0.40
ROWS_DROP_CRITICAL = 0.60
IQR_FENCE = 1.5

# --- Fixed values: monitoring message texts ----------------------------------------
Z_HINT = (
    "Value is %s standard deviations from the mean. "
    "Check for data pipeline issues, promotions, or external events."
)
NULL_HINT = (
    "%.1f%% of values are null in '%s'. "
    "Possible ingestion failure or upstream schema change."
)
SHIFT_HINT = (
    "Rolling mean shifted by %s%% in '%s'. "
    "Possible structural break, promotion, or data gap."
)
IQR_HINT = "Value lies outside the interquartile fences of '%s'."
EMPTY_DETAIL = "Table is empty."
EMPTY_HINT = "Ingestion may have never run or failed on first load."
STALE_HINT = "No new data for %d days. Check pipeline run logs and upstream data sources."
LATE_HINT = "Data is %d days old. Expected refresh cadence may have been missed."
FRESH_DETAIL = "Latest record: %s  (%d days ago)"
TOO_FEW_ROWS_DETAIL = "Insufficient data for row count comparison."
TOO_FEW_PERIODS_DETAIL = "Not enough periods to compare."
ROWS_DETAIL = "Recent: %.0f rows  |  Historical avg: %.0f rows"
ROWS_HINT = (
    "Row count dropped %.0f%% vs recent average (%.0f vs %.0f). "
    "Possible partial ingestion, upstream truncation, or filter change."
)
MISSING_DETAIL = "Missing columns: %s"
CHANGED_DETAIL = "Changed types: %s"
SCHEMA_OK_DETAIL = "All expected columns present."
SCHEMA_HINT = (
    "Schema change detected. Upstream source may have renamed or removed columns. "
    "Update ingestion mapping before proceeding."
)

# --- Fixed values: model quality gates ----------------------------------------------
FORECAST_MAPE_LIMIT = 20.0
MIX_MAPE_LIMIT = 25.0
R2_LIMIT = 0.50
INTERVAL_Z = 1.645
FORECAST_MAPE_TEXT = (
    "Model MAPE is %.1f%% — forecasts have high uncertainty. "
    "Consider expanding the date range or reviewing data quality."
)
FORECAST_R2_TEXT = (
    "Low R² (%.2f) — the model explains less than 50%% of variance. "
    "Results should be interpreted with caution."
)
MIX_MAPE_TEXT = (
    "MMM validation MAPE is %.1f%%. Channel contributions have high uncertainty — "
    "use for directional guidance only."
)
MIX_R2_TEXT = (
    "Low R² (%.2f). The model may be missing important drivers. "
    "Interpret contributions with caution."
)

# --- Fixed values: efficiency bands of the budget view ---------------------------------
ROAS_GREEN_FROM = 2.5
ROAS_AMBER_FROM = 1.9
SHIFT_MARGIN = 0.55
