"""The vocabulary, limits, folders and formats that results must show.

Everything here is data.  Jobs take the maps, lists and limits as parameters and use these as
defaults, so another document type or folder is one more entry passed by the caller.
"""

# --- fixed values: file types ------------------------------------------------------------
SUPPORTED_TYPES = (".pdf", ".docx", ".jpg", ".jpeg", ".png", ".txt", ".xlsx", ".pptx")
NON_DOCUMENT_TYPES = (".pptx", ".xlsx")
CLOUD_TEXT_TYPES = (".txt",)
CLOUD_OCR_TYPES = (".pdf", ".jpg", ".jpeg", ".png")

# --- fixed values: limits ----------------------------------------------------------------
LARGE_FILE_BYTES = 50 * 1024 * 1024
MIN_READABLE_CHARS = 10
MIN_SAMPLE_CHARS = 20  # a training line must be longer than this
MIN_SAMPLES = 10
CONFIDENCE_THRESHOLD = 70.0
PROMPT_CHARS = 1000
PREVIEW_CHARS = 300
RECENT_RESULTS = 20

# --- fixed values: labels and folders ----------------------------------------------------
LABELS = ("Resume", "Invoice", "Paystub", "Contract")
UNKNOWN = "Unknown"
ROUTES = {
    "Resume": "documents/hr/resumes",
    "Invoice": "documents/finance/invoices",
    "Paystub": "documents/finance/paystubs",
    "Contract": "documents/legal/contracts",
    "Unknown": "documents/unknown",
}
DEFAULT_ROUTE = "documents/unknown"
DUPLICATES_FOLDER = "documents/duplicates"
UNREADABLE_FOLDER = "documents/miscellaneous/unreadable"
UNSUPPORTED_FOLDER = "documents/miscellaneous/unsupported"
REJECTED_REPORT_FOLDER = "miscellaneous/unreadable"
CLOUD_PREFIXES = {
    "Resume": "hr/resumes/",
    "Invoice": "finance/invoices/",
    "Paystub": "finance/paystubs/",
    "Contract": "legal/contracts/",
    "Unknown": "unknown/",
}
DEFAULT_PREFIX = "unknown/"
CLOUD_UNSUPPORTED_FOLDER = "unsupported/"
CORPUS_LABELS = {
    "resumes.txt": "Resume",
    "invoices.txt": "Invoice",
    "paystubs.txt": "Paystub",
    "contracts.txt": "Contract",
}

# --- fixed values: statuses, reasons, methods --------------------------------------------
CHECK_MISSING = ("rejected", "File does not exist")
CHECK_EMPTY = ("rejected", "File is completely empty (0 bytes)")
CHECK_LARGE = ("warning", "File is large (over 50MB) - processing may take longer")
CHECK_OK = ("ok", "File is valid")
METHOD_ML = "ML Model"
METHOD_FALLBACK = "Ollama AI"
METHOD_FILE_TYPE = "file type check"
NON_DOCUMENT_STATUS = "non-document file type"
NO_LOGS = "no logs yet"

# --- fixed values: model settings --------------------------------------------------------
MAX_FEATURES = 3000
MAX_NGRAM = 3
INVERSE_REGULARISATION = 5.0
MAX_ITERATIONS = 1000
TEST_SHARE_PERCENT = 20
SPLIT_SEED = 42
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# --- fixed values: text formats ----------------------------------------------------------
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
CLOCK_FORMAT = "HH:mm:ss"
REPORT_RULE = "-" * 50
REPORT_TITLE = "PROCESSING REPORT - "
REPORT_FIELDS = (
    # (label, padded to 14 characters by the renderer; unit after the value)
    ("file name", ""),
    ("file size", " KB"),
    ("file type", ""),
    ("duplicate", ""),
    ("readable", ""),
    ("document type", ""),
    ("destination", ""),
    ("time taken", " seconds"),
    ("status", ""),
)
