"""Column names shared by every operator; each operator takes them as overridable parameters."""

KEYS = ("Store", "Dept")
DATE = "Date"
TARGET = "Weekly_Sales"
HOLIDAY = "IsHoliday"

MARKDOWNS = ("MarkDown1", "MarkDown2", "MarkDown3", "MarkDown4", "MarkDown5")
FACTORS = ("Temperature", "Fuel_Price", "CPI", "Unemployment")
TREND_PREFIX = "GoogleTrends_"

# Model names, in the order that breaks ties between equal errors.
MODEL_ORDER = (
    "Naive",
    "XGBoost",
    "Random Forest",
    "Ensemble",
    "Simple Average",
    "Seasonal Naive",
    "ARIMA",
    "SARIMA",
    "Prophet",
)
