"""Event vocabulary and other fixed values of the product's data model.

Everything here is data, not logic: operators take these as defaults and
callers may pass their own lists.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the analysed product's definitions)
# ---------------------------------------------------------------------------

# Funnel (pre-signup) events.
SCALE_PATH = "pr_funnel_scale_path"
ESCAPE_PATH = "pr_funnel_escape_path"
SIMPLIFY_PATH = "pr_funnel_simplify_path"
STARTER_PATH = "pr_funnel_starter_path"
PATH_EVENTS = (SCALE_PATH, ESCAPE_PATH, SIMPLIFY_PATH, STARTER_PATH)
EMAIL_SUBMIT = "pr_funnel_email_submit"
SUBSCRIBE = "pr_funnel_subscribe"
FUNNEL_EVENTS = PATH_EVENTS + (EMAIL_SUBMIT, SUBSCRIBE)
PATH_EVENT_LIKE = "pr_funnel_%_path"

# App (post-signup) events.
SIGNUP_CLICK = "pr_webapp_registration_signup_click"
REGISTRATION_VIEW = "pr_webapp_registration_view"
UPSELL_VIEW = "pr_webapp_upsell_view"
UPSELL_PURCHASE_CLICK = "pr_webapp_upsell_purchase_click"
UPSELL_PURCHASE = "pr_webapp_upsell_successful_purchase"
UNSUBSCRIBED = "pr_webapp_unsubscribed"
IOS_ACHIEVED = "pr_webapp_ios_succesfully_achieved"  # spelling as tracked
INSUFFICIENT_FUND_VIEW = "pr_webapp_upsell_insufficient_fund_view"
INSUFFICIENT_FUND_CLICK = "pr_webapp_upsell_insufficient_fund_click"
LESSON_EVENTS = (
    "pr_webapp_lesson_started",
    "pr_webapp_lesson_completed",
    "pr_webapp_lesson_csat_click",
    "pr_webapp_course_csat_click",
)
AI_EVENTS = (
    "pr_webapp_ai_chat_message_sent",
    "pr_webapp_ai_chat_message_received",
    "pr_webapp_ai_assistant_generate_click",
    "pr_webapp_ai_assistant_message_received",
)

# Tier-1 countries for the T1 / WW geo split.
T1_COUNTRIES = (
    "AE", "AT", "AU", "BH", "BN", "CA", "CZ", "DE", "DK", "ES", "FI", "FR",
    "GB", "HK", "IE", "IL", "IT", "JP", "KR", "NL", "NO", "PT", "QA", "SA",
    "SE", "SG", "SI", "US", "NZ",
)

EXCLUDED_COUNTRY = "KZ"
EXCLUDED_IP = "45.8.117.97"
EXCLUDED_CARD_TYPES = ("PREPAID",)
EXPERIMENT_CHANNEL = "primer"
TEST_EMAIL_LIKE = "%test%"
REGISTER_SOURCE = "register"
UNDEFINED_USER = "undefined"

# Gender spellings (English and Spanish).
FEMALE_VALUES = ("Female", "female", "Mujer")
MALE_VALUES = ("Male", "male", "Hombre")

# UTM sources folded into 'facebook', and sources kept as they are.
FACEBOOK_UTM = ("fb_bio", "fb_page", "fb_post", "facebook", "insta_bio")
KEPT_UTM = ("TikTok", "google", "unionapps")

# Upsell slot <-> payment rebill_count code.
REBILL_BY_ORDER = {"1": (-14,), "2": (-20, -22)}
UPSELL_REBILL_CODES = (-14, -20, -22)
INSUFFICIENT_FUNDS_MESSAGE = "Insufficient Funds"
REFUND_TAG_LIKE = "%upsell refund%"
UPSELL_VERSION_URL_PATTERN = r"[?&]upsell_version=([^&]+)"

# User-agent classification, first match wins.
MOBILE_UA_PATTERN = r"(Android|iPhone|Windows Phone|iPad|BlackBerry|webOS|Kindle)"
DESKTOP_UA_PATTERN = r"(Windows NT|Macintosh|Linux|X11)"
OS_RULES = (
    (r"Android", "Android"),
    (r"iPhone|iPad|iPod", "iOS"),
    (r"Windows NT", "Windows"),
    (r"Mac OS X", "Mac OS"),
    (r"Linux", "Linux"),
)
DEVICE_MODEL_RULES = (
    (r"iPhone17,1", "iPhone16 Pro"),
    (r"iPhone17,2", "iPhone16 Pro Max"),
    (r"iPhone17,3", "iPhone16"),
    (r"iPhone17,4", "iPhone16 Plus"),
    (r"iPhone17,5", "iPhone16e"),
    (r"iPhone16,1", "iPhone15 Pro"),
    (r"iPhone16,2", "iPhone15 Pro Max"),
    (r"iPhone15,4", "iPhone15"),
    (r"iPhone15,5", "iPhone15 Plus"),
    (r"iPhone15,2", "iPhone14 Pro"),
    (r"iPhone15,3", "iPhone14 Pro Max"),
    (r"iPhone", "iPhone (generic)"),
    (r"(SM-S931B|SM-S931U)", "Samsung Galaxy S25"),
    (r"(SM-S928B/DS|SM-S928W)", "Samsung Galaxy S24 Ultra"),
    (r"(SM-S911B|SM-S911U)", "Samsung Galaxy S23"),
    (r"(SM-S901B|SM-S901U)", "Samsung Galaxy S22"),
    (r"Pixel 9 Pro", "Google Pixel 9 Pro"),
    (r"Pixel 9", "Google Pixel 9"),
    (r"Pixel 8 Pro", "Google Pixel 8 Pro"),
    (r"Pixel 8", "Google Pixel 8"),
)

# Retention buckets: (label, inclusive upper bound in whole minutes).
# Anything above the last bound is '> 30'.
RETENTION_BUCKETS = (
    ("Day 0", 1440),
    ("Day 1", 2880),
    ("Day 2", 4320),
    ("Day 3", 5760),
    ("Day 4", 7200),
    ("Day 5", 8640),
    ("Day 6", 10080),
    ("Day 7", 11520),
    ("Day 30", 44640),
)
RETENTION_OVERFLOW = "> 30"
MINUTES_PER_DAY = 1440
DAILY_RETENTION_LAST_DAY = 30

# Experiment analysis defaults.
N_BOOTSTRAP = 10_000
CONFIDENCE_LEVEL = 0.95
RANDOM_SEED = 42
MIN_SEGMENT_ROWS = 20
SEGMENT_AXES = (
    ("Subscription", "subscription"),
    ("UTM_Source", "utm_source"),
    ("Geo", "geo"),
    ("Payment_Method", "payment_method"),
    ("Channel", "channel"),
)
# Metrics where an increase is bad; the summary flips their direction.
NEGATIVE_METRICS = (
    "Unsub 12h Rate (on View)",
    "Unsub 12h Rate (on Upsell Purchase)",
    "Ticket Users Share (on All Users)",
    "Ticket Users Share (on Purch Users)",
)

# JSON keys read from event_metadata / query_parameters (all scalar strings).
EVENT_METADATA_KEYS = (
    "personal_plan_pk", "age", "country_code", "gender", "subscription",
    "channel", "payment_method", "utm_source", "email", "scale_path",
    "escape_path", "starter_path", "simplify_path", "upsell_version",
    "funnel_version", "subscription_id", "quiz_version", "upsell_order",
    "upsell_amount", "insufficient_fund", "card_type",
)
QUERY_PARAMETER_KEYS = ("source",)
