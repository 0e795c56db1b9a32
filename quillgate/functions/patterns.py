"""Dictionaries and patterns of the detectors. Results depend on each of them
and on their order."""

# fixed values: category, expression, whether a bare match is already strong
TEXT_PATTERNS = [
    ("aadhaar", r"\b\d{4}\s?\d{4}\s?\d{4}\b", False),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", True),
    ("creditCard", r"\b(?:\d[ -]*?){13,19}\b", False),
    ("bankAccount", r"\b\d{9,18}\b", False),
    ("email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", True),
    ("phone", r"\b(?:\+?\d{1,3}[-\s]?)?\d{10}\b", False),
    ("mobile", r"\b[6-9]\d{9}\b", True),
    ("dob", r"\b(0[1-9]|[12]\d|3[01])[/\-.](0[1-9]|1[0-2])[/\-.](19|20)\d{2}\b", True),
    ("otp", r"\b\d{4,8}\b", False),
    ("pincode", r"\b[1-9]\d{5}\b", False),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", True),
]
# what every match of a pattern holds, quick to look for; texts without it are passed over
_DATE, _CARD = r"[0-9][/.\-][01][0-9][/.\-][12]", r"(?:[0-9][ -]*+){13}"
NEEDS = {"aadhaar": "[0-9]{4}", "pan": "[A-Z]{5}[0-9]{4}", "creditCard": _CARD, "bankAccount": "[0-9]{9}", "email": "@", "phone": "[0-9]{10}", "mobile": "[6-9][0-9]{9}", "dob": _DATE, "otp": "[0-9]{4}", "pincode": "[1-9][0-9]{5}", "ifsc": "[A-Z]{4}0", "upi": "@"}
CONTEXT_WORDS = {
    "aadhaar": ["aadhaar", "aadhar", "uidai", "unique identification"],
    "pan": ["pan number", "pan card", "permanent account number"],
    "creditCard": ["card number", "credit card", "debit card", "cvv", "expiry"],
    "bankAccount": ["account number", "a/c no", "bank account", "ifsc", "account no"],
    "phone": ["phone", "mobile", "contact", "call", "tel"],
    "dob": ["date of birth", "dob", "birth date"],
    "otp": ["otp", "one time password", "verification code", "auth code"],
    "pincode": ["pincode", "pin code", "postal code", "pin", "postal"],
}
CONTEXT_SPAN = 60
# fixed values: category, expression (case-insensitive), confidence
LABELED_PATTERNS = [
    ("name", r"(?:(?:full|customer|applicant|holder|card ?holder|account holder|candidate|student|employee)\s+)?name\s*[:=]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})", 0.9),
    ("dob", r"\b(?:date of birth|dob|birth ?date)\s*[:=]\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})", 0.9),
    ("address", r"(?:residential|permanent|correspondence|postal|current)?\s*address\s*[:=]\s*(.{0,120})", 0.85),
]
ADDRESS_HINTS = r"road|street|lane|nagar|colony|avenue|town|city|apartment|flat|floor|phase|block|sector|p\.?o\.?|district|tehsil|state|pin"
ADDRESS_CLIP = 160

# fixed values: form fields
INPUT_TYPES = ["password", "tel", "email"]
AUTOCOMPLETE = ["current-password", "new-password", "one-time-code", "cc-number", "cc-csc", "cc-exp", "bday", "tel", "email", "name", "given-name", "family-name", "street-address", "postal-code", "organization"]
NAME_HINTS = ["password", "passwd", "otp", "aadhaar", "aadhar", "pan", "ssn", "card", "cvv", "account", "dob", "birth", "phone", "mobile", "name", "address", "pin", "ifsc", "upi", "salary", "income", "medical", "passport", "voter", "employee id", "college id", "email"]

# fixed values: documents
DOCUMENT_KEYWORDS = {
    "pan": ["permanent account number", "pan card", "income tax department", "pan number"],
    "aadhaar": ["aadhaar", "aadhar", "uidai", "unique identification authority", "government of india", "my aadhaar", "aadhaar number"],
    "passport": ["passport", "republic of india", "mrz", "machine readable zone"],
    "driving_license": ["driving licence", "driving license", "driving no", "dl no"],
    "voter_id": ["voter id", "voter identity", "election commission", "epic no", "elector"],
    "employee_id": ["employee id", "employee code", "staff id", "employee identity", "badge"],
    "college_id": ["college id", "student id", "university id", "enrollment no", "roll no", "registration no"],
    "bank": ["bank statement", "account statement", "ifsc", "account number", "savings account"],
    "credit_card": ["credit card", "debit card", "card number", "cvv", "expiry", "cardholder name"],
    "cheque": ["cheque", "check", "pay to the order of", "micr"],
    "tax_document": ["form 16", "form 26as", "income tax return", "gst", "tds", "tax invoice", "deduction"],
    "salary": ["salary slip", "payslip", "pay slip", "basic salary", "gross pay", "net pay", "allowance"],
    "medical": ["medical report", "prescription", "patient", "diagnosis", "clinical", "lab report", "x-ray", "blood report"],
    "legal": ["legal document", "affidavit", "agreement", "notary", "court", "deed", "power of attorney"],
    "private_message": ["private message", "direct message", "chat", "conversation", "inbox"],
    "confidential": ["confidential", "internal use only", "proprietary", "company confidential", "restricted"],
    "generic_identity": ["identity card", "id card", "date of birth", "signature"],
}
FILE_HINTS = [
    (r"pan[_-]?card", "pan", 0.9),
    (r"aadhaar|uidai", "aadhaar", 0.9),
    (r"passport", "passport", 0.9),
    (r"driv(ing)?[_-]?licen", "driving_license", 0.9),
    (r"voter[_-]?id|epic", "voter_id", 0.9),
    (r"employee[_-]?id|staff[_-]?id|badge", "employee_id", 0.8),
    (r"college[_-]?id|student[_-]?id|enrollment|roll[_-]?no", "college_id", 0.8),
    (r"statement|bank", "bank", 0.7),
    (r"cheque|check[_-]?book", "cheque", 0.8),
    (r"tax|form[_-]?16|26as|gst|tds", "tax_document", 0.8),
    (r"salary|payslip|pay[_-]?slip", "salary", 0.8),
    (r"medical|prescription|diagnosis|lab[_-]?report", "medical", 0.7),
    (r"legal|affidavit|agreement|deed", "legal", 0.7),
    (r"confidential|internal|proprietary", "confidential", 0.7),
    (r"id[_-]?card|identity", "generic_identity", 0.6),
]
MIME_TYPES = ["application/pdf", "image/tiff", "image/x-tiff", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]
LABELS = [
    (["pan", "aadhaar", "passport", "driving_license", "voter_id", "employee_id", "college_id", "generic_identity"], "[IDENTITY DOCUMENT REDACTED]"),
    (["bank", "credit_card", "cheque", "tax_document", "salary", "statement"], "[FINANCIAL DOCUMENT REDACTED]"),
    (["medical"], "[MEDICAL DOCUMENT REDACTED]"),
    (["legal"], "[LEGAL DOCUMENT REDACTED]"),
    (["private_message", "confidential"], "[PRIVATE CONTENT REDACTED]"),
]
OTHER_LABEL = "[DOCUMENT REDACTED]"
DOC_PAN, DOC_IFSC = r"\b[A-Z]{5}\d{4}[A-Z]\b", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"

# fixed values: leak scan
ALWAYS_BLOCK = ["pan", "email", "dob"]
SCAN_CHARS = 512
GATE_PATTERNS = [
    ("phone", r"\b[6-9]\d{9}\b"),
    ("phone", r"\b\+?\d{1,3}[-\s]?\d{10}\b"),
    ("aadhaar", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("dob", r"\b(0[1-9]|[12]\d|3[01])[/\-.](0[1-9]|1[0-2])[/\-.](19|20)\d{2}\b"),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("upi", r"(?i)\b[\w.-]{2,}@[a-z]{2,}(?!\.)\b"),
]
CARD = r"\b(?:\d[ -]*?){13,19}\b"
FILE_NAMES = ["pan[_-]?card", "aadhaar", "uidai", "passport", "driv(ing)?[_-]?licen", "voter[_-]?id", "employee[_-]?id", "student[_-]?id", "college[_-]?id", "statement", "cheque", "tax|form[_-]?16|26as", "salary|payslip", "medical|prescription", "confidential|proprietary|internal"]
API_KEYS = [r"sk-[A-Za-z0-9_-]{16,}", r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{20,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"(?:eyJ|gAAAA)[A-Za-z0-9._-]{16,}", r"[A-Za-z0-9]{32,}"]
BASE64_BODY, DATA_URL, LEAST_RUN = "^[A-Za-z0-9+/]{32,}={0,2}$", "^data:[^;,]*;base64,", 6
BEARER = r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{10,}"
SENSITIVE_KEYS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "authorization", "access_token", "accesstoken", "credential", "vault", "masterpassword", "master_password", "cvv", "cardnumber", "ccnumber", "cc_csc", "otp", "aadhaar", "aadhar", "pan"]
IMAGE_KEYS = ["filedataurl", "file_data_url", "originalimage", "original_image", "rawscreenshot", "raw_screenshot", "unredacted"]

# fixed values: activity log and actions
LOG_KEYS = ["content", "value", "text", "credential", "file", "password"]
ACTIVITY_KEYS = ["value", "content", "text", "password", "credential", "token", "secret", "ocrText", "ocr_text", "innerText", "file", "fileName", "fileDataUrl", "match"]
ACTIVITY_EVENTS = [
    ("vlm_load_warning", "Local model unavailable", "warn"),
    ("model_loaded", "Local model loaded", "ok"),
    ("vlm_perception_warning", "Perception warning", "warn"),
    ("reused_cached_perception", "Used cached perception", "ok"),
    ("privacy_gate", "Privacy scan completed", "ok"),
    ("privacy_state", "Privacy state evaluated", "ok"),
    ("remote_plan_received", "Sanitized context sent to remote model", "ok"),
    ("no_route_available", "No route available", "warn"),
    ("action_error", "Action error", "warn"),
    ("action_warning", "Action may have had no effect", "warn"),
    ("action_needs_confirmation", "Sensitive action needs confirmation", "warn"),
    ("action_failed_final", "Action failed", "warn"),
    ("action_executed", "Action executed locally", "ok"),
    ("task_complete", "Task complete", "ok"),
    ("error", "Error", "warn"),
    ("screenshot_sanitized", "Screenshot sanitized", "ok"),
    ("sensitive_document_redacted", "Sensitive document redacted", "ok"),
    ("remote_payload_approved", "Remote payload approved", "ok"),
    ("potential_leak_blocked", "Potential leak blocked", "blocked"),
    ("credential_action_local", "Credential action kept local", "ok"),
    ("ocr_blocked", "OCR unavailable — request blocked", "blocked"),
]
SAFE_VARIANTS = ["mouse:scroll", "keyboard:tab", "browser:tab:switch"]
PRIVATE_VARIANTS = ["local:fill_credential", "browser:upload_file"]
DESTRUCTIVE_WORDS = ["submit", "pay", "payment", "confirm", "send", "delete", "remove", "place_order", "checkout", "transfer", "purchase", "sign"]

# fixed values: settings by default, as text
DEFAULT_SETTINGS = {
    "LOCAL_FIRST": "true", "ALLOW_REMOTE_REASONING": "true", "PRIVACY_MODE": "strict", "LOCAL_VLM_MODEL": "", "LOCAL_VLM_DEVICE": "auto", "LOCAL_VLM_DTYPE": "auto", "REMOTE_ENDPOINT": "", "REMOTE_API_KEY": "",
    "MAX_STEPS": "25", "CHANGE_DETECTION_THRESHOLD": "0.02", "FAIL_CLOSED": "true", "ENABLE_FACE_REDACTION": "true", "ENABLE_QR_BARCODE": "true", "ENABLE_SIGNATURE": "true", "ACTIVITY_RETENTION": "50",
}

URL_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#@]+)"

# fixed values: the setting that turns a kind of visual region off
VISUAL_SETTINGS = {"face": "ENABLE_FACE_REDACTION", "qr_code": "ENABLE_QR_BARCODE", "barcode": "ENABLE_QR_BARCODE", "signature": "ENABLE_SIGNATURE"}

# fixed values: why there is no plan
PLAN_EMPTY, PLAN_UNREAD, PLAN_WITHOUT_ACTIONS = "Empty remote response", "Remote plan is no JSON", "Remote plan missing actions[]"

# fixed values: keys of a form field that are marked, sanitized, or kept on the machine
STRIPPED_FIELDS = ["value", "innerText", "textContent", "data", "src", "href", "action", "fileName", "file_name"]
TEXT_FIELDS = ["label", "placeholder", "name", "alt", "ariaLabel", "title"]
LOCAL_FIELDS = ["selectorPath", "value", "fileDataUrl", "fileName"]

# fixed values: status by level
STATUS = {
    "blocked": "Request blocked", "running": "Processing locally", "loading": "Loading local model", "unavailable": "Local model unavailable", "no_ocr": "Needs attention", "ready": "Protected locally", "other": "Protected",
}

# fixed values: what the status says beside its title
STATUS_DETAIL = {
    "running": "Inspecting and sanitizing page context before anything leaves the browser.",
    "loading": "A local model is initializing on this device.",
    "unavailable": "Visual context cannot be verified; requests are blocked or fall back to DOM-only checks.",
    "no_ocr": "Local OCR is unavailable. Suspicious images are redacted in full or blocked.",
    "ready_remote": "Local processing active; remote reasoning receives only sanitized context.",
    "ready": "Local processing active; remote reasoning is disabled.",
    "other": "Privacy layer is active. Local model not configured (DOM-only protection).",
}

# fixed values: why a privacy state holds
STATE_REASONS = {
    "leak": "final payload scanner detected a leak",
    "no_scan": "final payload scanner failed (cannot prove safety)",
    "redaction": "redaction layer failed — cannot produce sanitized payload",
    "document": "uncertain high-sensitivity document — must redact whole region",
    "blind": "sensitive content present but perception/OCR unavailable",
    "regions": "sensitive content detected — redaction required",
    "safe": "payload proven safe",
}

# fixed values: why an action may be tried again or not
RETRY_REASONS = {
    "private": "sensitive/destructive action (fills or uploads private data)",
    "safe": "observational/low-risk action",
    "harmful": "action targets a submit/pay/send/delete style control",
    "neutral": "neutral action",
}
