"""Fixed values the results depend on, as the reference states them.

Everything here must equal the reference for the outputs to match; the rest
of the library imports these names rather than repeating the literals.
"""

# --- fixed values (from the reference) -------------------------------------
POSITIVE_RATING = 4                 # rating >= 4 is positive, < 4 negative
RECENT_REVIEWS = 5                  # latest reviews shown per business
DEFAULT_REVIEW_SOURCE = "direct"    # reviews.source default
TRIAL_DAYS = 14                     # trial end = trial start + 14 days
TRIAL_QUOTA = 10                    # reviews granted when a trial starts
DEFAULT_PAYMENT_METHOD = "credit_card"
FLAT_EARNING = 75                   # earning recorded per payment
COMMISSION_RATE = 0.20              # 20 % of a subscription or payment amount
INVOICE_NO_STATUS = "Inactive"
INVOICE_NO_PAYMENT = "N/A"
INVOICE_NO_ADDRESS = "Not provided"
CARD_LABEL_JOIN = " ending in "     # "<Brand> ending in <last4>"
REVIEW_PATH = "/review/"            # {base}/review/{url_id}
SIGNUP_PATH = "/signup?ref="        # {base}/signup?ref={code}
QR_ID_LENGTH = 15
REFERRAL_CODE_LENGTH = 8
COUPON_CODE_PATTERN = "[A-Z0-9]{4,16}"
BANK_RULES = [                      # field, pattern, message, in check order
    ("transit_number", r"\d{5}", "Transit number must be 5 digits"),
    ("institution_number", r"\d{3}", "Institution number must be 3 digits"),
    ("account_number", r"\d{7,12}", "Account number must be 7-12 digits"),
]
EVENT_KINDS = {                     # provider event type -> kind handled
    "checkout.session.completed": "checkout",
    "customer.subscription.updated": "updated",
    "customer.subscription.deleted": "deleted",
    "invoice.payment_succeeded": "paid",
}
# ---------------------------------------------------------------------------
