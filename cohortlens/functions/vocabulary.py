"""Fixed values of the payment source: columns, vocabularies and audited bounds."""

from __future__ import annotations

# Source columns in file order.
SOURCE_COLUMNS = (
    "transaction id",
    "timestamp",
    "transaction type",
    "merchant_category",
    "amount (INR)",
    "transaction_status",
    "sender_age_group",
    "receiver_age_group",
    "sender_state",
    "sender_bank",
    "receiver_bank",
    "device_type",
    "network_type",
    "fraud_flag",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
)
# Source columns a file may lack.
OPTIONAL_COLUMNS = ("sender_age_group", "receiver_age_group", "hour_of_day", "day_of_week", "is_weekend")
REQUIRED_COLUMNS = tuple(c for c in SOURCE_COLUMNS if c not in OPTIONAL_COLUMNS)

# Vocabularies.
STATUSES = ("SUCCESS", "FAILED")
METHODS = ("P2P", "P2M", "Bill Payment", "Recharge")
CATEGORIES = (
    "Grocery", "Food", "Shopping", "Fuel", "Other", "Utilities", "Transport", "Entertainment", "Healthcare", "Education",
)
DEVICES = ("Android", "iOS", "Web")
NETWORKS = ("4G", "5G", "WiFi", "3G")
REGIONS = (
    "Maharashtra", "Uttar Pradesh", "Karnataka", "Tamil Nadu", "Delhi",
    "Telangana", "Gujarat", "Andhra Pradesh", "Rajasthan", "West Bengal",
)
BANKS = ("SBI", "HDFC", "ICICI", "IndusInd", "Axis", "PNB", "Yes Bank", "Kotak")

# Audited inclusive bounds (local time) and amounts.
TIME_MIN, TIME_MAX = "2024-01-01 00:05:10", "2024-12-30 23:55:40"
AMOUNT_MIN, AMOUNT_MAX = 10, 42099
LOCAL_ZONE = "Asia/Kolkata"
