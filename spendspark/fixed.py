"""They must equal what the claims application uses, so that the
results agree. Everything here is data, given in its natural order."""

# --- enumerations, in declaration order (the order also drives sorting) --------
ROLES = ["employee", "approver", "admin"]
STATUSES = ["draft", "pending", "approved", "rejected", "reimbursed", "changes_requested"]
CATEGORIES = [
    "meals", "transportation", "accommodation", "office_supplies", "software",
    "training", "marketing", "travel", "other",
]
OCR_STATUSES = ["pending", "processing", "completed", "failed"]
PRIVILEGED_ROLES = ["approver", "admin"]

DEFAULT_CURRENCY = "BRL"
RECEIPT_MAX_BYTES = 10 * 1024 * 1024
AVATAR_MAX_BYTES = 2 * 1024 * 1024
RATE_WINDOW_MINUTES = 15
RATE_MAX_REQUESTS = 100
VERIFICATION_TOKEN_HOURS = 24
RESET_TOKEN_MINUTES = 10
TRAIN_MIN_SAMPLES = 50
FIT_MIN_SAMPLES = 10

# --- category keyword lists: share of matched keywords is the score -------------
KEYWORDS = {
    "meals": [
        "restaurant", "food", "lunch", "dinner", "breakfast", "cafe", "coffee",
        "pizza", "burger", "sushi", "delivery", "takeout", "meal", "dining",
    ],
    "transportation": [
        "uber", "lyft", "taxi", "bus", "train", "subway", "metro", "airline",
        "flight", "car rental", "parking", "toll", "gas", "fuel", "mileage",
    ],
    "accommodation": [
        "hotel", "motel", "inn", "resort", "airbnb", "booking", "lodging",
        "accommodation", "stay", "room", "suite",
    ],
    "office_supplies": [
        "staples", "office", "supplies", "paper", "pen", "pencil", "notebook",
        "folder", "binder", "printer", "ink", "toner", "desk", "chair",
    ],
    "software": [
        "software", "app", "subscription", "license", "saas", "cloud", "microsoft",
        "adobe", "google", "zoom", "slack", "github", "aws", "digital",
    ],
    "training": [
        "course", "training", "workshop", "seminar", "conference", "education",
        "learning", "certification", "udemy", "coursera", "book", "tutorial",
    ],
    "marketing": [
        "advertising", "marketing", "promotion", "social media", "facebook",
        "google ads", "linkedin", "campaign", "branding", "design",
    ],
    "travel": [
        "travel", "trip", "business trip", "visa", "passport", "insurance",
        "luggage", "baggage", "airport", "terminal",
    ],
}

# smaller keyword lists of the scoring service's fallback
SERVICE_KEYWORDS = {
    "meals": ["restaurant", "food", "lunch", "dinner", "cafe", "pizza"],
    "transportation": ["uber", "taxi", "bus", "flight", "gas", "parking"],
    "accommodation": ["hotel", "airbnb", "booking", "room"],
    "office_supplies": ["office", "supplies", "paper", "pen", "printer"],
    "software": ["software", "app", "subscription", "license"],
    "training": ["course", "training", "workshop", "conference"],
    "marketing": ["advertising", "marketing", "promotion"],
    "travel": ["travel", "trip", "visa", "luggage"],
}

# amount hints: (exclusive upper bound, [(category, hint), ...]); None = no bound
AMOUNT_HINTS = [
    (20, [("meals", 0.3), ("office_supplies", 0.2)]),
    (100, [("meals", 0.4), ("transportation", 0.3), ("office_supplies", 0.1)]),
    (500, [("accommodation", 0.3), ("software", 0.2), ("training", 0.2)]),
    (None, [("travel", 0.4), ("accommodation", 0.3), ("training", 0.2)]),
]
ACCEPT_CONFIDENCE = 0.3

# service fallback: amount below 20, amount above 500
SERVICE_LOW_BONUS = {"meals": 0.2}
SERVICE_HIGH_BONUS = {"travel": 0.3, "accommodation": 0.2}

AMOUNT_BINS = [(20, "low"), (100, "medium"), (500, "high"), (None, "very_high")]

# --- receipt patterns, tried in this order ---------------------------------------
AMOUNT_PATTERNS = [
    r"(?i)total[:\s]*[$]?(\d+[.,]\d{2})",
    r"(?i)amount[:\s]*[$]?(\d+[.,]\d{2})",
    r"(?i)[$]?(\d+[.,]\d{2})\s*total",
    r"(?m)[$]?(\d+[.,]\d{2})$",
]
DATE_PATTERNS = [
    r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
    r"(\d{2,4}[/\-]\d{1,2}[/\-]\d{1,2})",
    r"(\d{1,2}\s+\w+\s+\d{2,4})",
]
TOTAL_KEY_PARTS = ["total", "amount"]
DATE_KEY_PARTS = ["date", "time"]
MONTH_PREFIXES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# --- system settings at installation ----------------------------------------------
DEFAULT_SETTINGS = {
    "approval_thresholds": {"auto_approve_limit": 100, "requires_manager": 500, "requires_admin": 1000},
    "ocr_settings": {"confidence_threshold": 0.8, "retry_attempts": 3, "timeout_seconds": 30},
    "ml_settings": {"categorization_threshold": 0.7, "retrain_interval_days": 30},
}

# --- validation messages --------------------------------------------------------
MSG_TITLE = "Title is required and must be less than 255 characters"
MSG_DESCRIPTION = "Description must be less than 1000 characters"
MSG_AMOUNT = "Amount must be a positive number"
MSG_CURRENCY = "Currency must be 3 characters"
MSG_DATE = "Valid expense date is required"
MSG_DATE_FUTURE = "Date cannot be in the future"
MSG_VENDOR = "Vendor name must be less than 255 characters"
MSG_CATEGORY = "Invalid category"
MSG_EMAIL = "Please provide a valid email"
MSG_EMAIL_TAKEN = "User with this email already exists"
MSG_FIRST_NAME = "First name must be 1-100 characters"
MSG_LAST_NAME = "Last name must be 1-100 characters"
MSG_DEPARTMENT = "Department must be less than 100 characters"
MSG_ROLE = "Invalid role"
MSG_FILE_TYPE = "Only JPEG, PNG, and PDF files are allowed"
MSG_AVATAR_TYPE = "Only JPEG and PNG images are allowed for avatars"
MSG_FILE_SIZE = "File size must be less than 10MB"

# --- workflow refusals -----------------------------------------------------------
REFUSE_UNKNOWN_ACTOR = "The user belonging to this token no longer exists."
REFUSE_INACTIVE_ACTOR = "Your account has been deactivated. Please contact administrator."
REFUSE_ROLE = "You do not have permission to perform this action"
REFUSE_NOT_FOUND = "Expense not found"
REFUSE_ACCESS = "You can only access your own expenses"
REFUSE_NO_APPROVER = "No approvers available"
REFUSE_COMMENT_ACCESS = "You can only comment on your own expenses or expenses you can approve"
REFUSE_TEXT = {
    "reject": "Rejection reason is required",
    "request_changes": "Change request message is required",
    "comment": "Comment cannot be empty",
}
REFUSE_STATE = {
    "update": "Can only update expenses in draft status",
    "submit": "Can only submit expenses in draft status",
    "delete": "Can only delete expenses in draft status",
    "approve": "Can only approve pending expenses",
    "reject": "Can only reject pending expenses",
    "request_changes": "Can only request changes for pending expenses",
    "reimburse": "Can only reimburse approved expenses",
}
REFUSE_SELF_ROLE = "Cannot change your own role"
REFUSE_SELF_STATUS = "Cannot change your own account status"
REFUSE_NO_USER = "User not found"
REFUSE_NO_FIELDS = "No fields to update"
REFUSE_NO_NOTIFICATION = "Notification not found"
REFUSE_NO_SETTING_VALUE = "Setting value is required"

# --- audit actions, states and default notes ---------------------------------------
# action: (required state, new state, audit action, default note)
TRANSITIONS = {
    "submit": ("draft", "pending", "submitted", "Expense submitted for approval"),
    "approve": ("pending", "approved", "approved", "Expense approved"),
    "reject": ("pending", "rejected", "rejected", None),
    "request_changes": ("pending", "changes_requested", "changes_requested", None),
    "reimburse": ("approved", "reimbursed", "reimbursed", "Expense reimbursed"),
}
NOTE_CREATED = "Expense created"
NOTE_UPDATED = "Expense details updated"
NOTE_APPROVED_BACKFILL = "Expense approved by approver"

# --- notifications: type, title, message ({actor}, {title}, {currency}, {amount}) ----
NOTIFICATIONS = {
    "submit": ("approval_request", "New expense requires approval",
               "{actor} submitted an expense for {currency} {amount}"),
    "approve": ("expense_approved", "Expense approved",
                'Your expense "{title}" has been approved by {actor}'),
    "reject": ("expense_rejected", "Expense rejected",
               'Your expense "{title}" has been rejected by {actor}'),
    "request_changes": ("changes_requested", "Changes requested for expense",
                        '{actor} has requested changes to your expense "{title}"'),
    "reimburse": ("expense_reimbursed", "Expense reimbursed",
                  'Your expense "{title}" has been reimbursed'),
}
PREFERENCE_FLAGS = ["email", "in_app", "expense_approved", "expense_rejected", "expense_submitted"]

# --- currency signs of the pt-BR locale -----------------------------------------------
CURRENCY_SIGNS = {"BRL": "R$", "USD": "US$", "EUR": "€", "GBP": "£"}
