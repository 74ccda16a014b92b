"""The labels, patterns and column names of the fund pages."""

# Composition page: column -> pattern over the page text, group 1 is the value.
COMPOSITION_PATTERNS = {
    "total_advance_subscription": r"Amount of Total Advance Subscription[^\d]+([\d,]+)",
    "nav": r"Net Asset Value[^\d]+([\d,]+)",
    "total_units": r"Total Units Outstanding[^\d]+([\d,]+)",
    "net_unit_change": r"Net Unit Change[^\d-]+([-\d,]+)",
    "nav_per_unit": r"NAV Per Unit[^\d]+([\d.]+)",
    "creation_unit": r"Creation/Redemption Unit[^\d]+([\d,]+)",
    "equity_value_basket": r"Equity Value Per Basket[^\d]+([-\d,]+)",
    "cash_component": r"Cash Component Per Basket[^\d-]+([-\d,]+)",
    "price_per_basket": r"Price per Creation Basket[^\d]+([-\d,]+)",
}
COMPOSITION_FLAGS = {
    "fund_purchase": "Fund Purchase Yes",
    "fund_redemption": "Fund Redemption Yes",
}
# Assets page.
NAV_PATTERNS = {
    "net_asset_value": r"Net Asset Value[^\d]+([\d,]+)",
    "total_units": r"Total Units Outstanding[^\d]+([\d,]+)",
    "nav_per_unit": r"NAV Per Unit[^\d]+([\d.]+)",
}
RATE_PATTERNS = {
    "usd_to_twd": r"1 USD\s*=\s*([\d.]+)\s*TWD",
    "usd_to_vnd": r"1 USD\s*=\s*([\d.,]+)\s*VND",
}
DATE_PATTERN = r"Date:\s*(\d{4}/\d{2}/\d{2})"
TABLE_CLASS = "table1"
HOLDINGS_MARK = "VIC VN"
STOCK_MARK = "VN"
TOTAL_MARK = "Total"
CASH_MARKS = ("Cash", "Holdings")
# Cash label fragments -> column; a label with all fragments matches, tested in
# this order.
CASH_LABELS = (
    (("Cash (TWD)",), "cash_twd"),
    (("Cash (USD)",), "cash_usd"),
    (("Cash (VND)",), "cash_vnd"),
    (("Payables", "TWD"), "payables_twd"),
)
