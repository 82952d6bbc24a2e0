"""Fixed job parameters for the registered queries (FIXTURES.md §2)."""

AS_OF_ORDERS = "2001-08-01 00:00:00"   # "now" for order-based tables
AS_OF_EVENTS = "2024-01-31 00:00:00"   # "now" for event-based tables
RANGE_START = "1998-01-01 00:00:00"    # report range; a date-only end bound is
RANGE_END = "1998-06-30 00:00:00"      # midnight, as in the reference (X20)
BASE_URL = "https://app.example.com"
