"""Fixed values. They decide results, so they are stated once, here."""

# Spreadsheet error tokens, compared in lower case with the whole cell.
EXCEL_ERRORS = [
    "#n/a", "#value!", "#ref!", "#div/0!", "#num!", "#name?", "#null!",
    "#getting_data", "#spill!", "#calc!", "#field!", "#unknown!",
]

# Fixed values: "not available" tokens, compared in lower case with the whole cell.
NA_TOKENS = ["", "n/a", "na", "null", "none", "#n/a", "nan", "-"]

# Cells that mean "same as above".
DITTO_MARKS = ['"', "'", "nt", "nt.", "như trên"]

# Words read as true and false, in lower case.
TRUE_WORDS = ["x", "✓", "✔", "có", "yes", "true", "1", "đúng"]
FALSE_WORDS = ["✗", "✘", "không", "no", "false", "0", "sai"]

# Formats of numbers, percentages, amounts and codes (ASCII digits only).
VN_NUMBER = r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"
US_NUMBER = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
COMMA_DECIMAL = r"^-?[0-9]+,[0-9]+$"
GROUPED_OR_PLAIN = (
    r"-?(?:[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
)
PERCENT = r"(?U)^" + GROUPED_OR_PLAIN + r"\s*%$"
MARK_BEFORE = r"[$€£¥₫]"
MARK_AFTER = r"(?:đồng|VND|VNĐ|USD|\$|€|£)"
AMOUNT = (
    r"(?Ui)^(?:" + MARK_BEFORE + r"\s*" + GROUPED_OR_PLAIN + r"\s*" + MARK_AFTER + r"?|"
    + GROUPED_OR_PLAIN + r"\s*" + MARK_AFTER + r")$"
)
NUMERIC_LOOKING = (
    r"(?:" + MARK_BEFORE + r"\s*)?" + GROUPED_OR_PLAIN + r"(?:\s*(?:%|" + MARK_AFTER + r"))?|-?[0-9]+,[0-9]+"
)
CURRENCY_MARK = r"(?Ui)[$€£¥₫]|đồng|VND|VNĐ|USD"
LEADING_ZERO = r"^0[0-9]+$"

# Header search limits and the vote threshold.
HEADER_SCAN_ROWS = 30
MAX_HEADER_ROWS = 6
VOTE_THRESHOLD = 0.7

# Head size and candidate delimiters of the sniffer.
DELIMITER_SAMPLE_CHARS = 8192
DELIMITERS = ",;\t|"

# Code fence around a statement, and words of a placeholder comment.
SQL_FENCE = r"(?Uis)```(?:sqlite|sql)?\s*(.*?)\s*```"
PLACEHOLDER_COMMENT = r"(?Ui)^--\s*(your\s+sql|sql\s+query|write\s+your)"
SQL_KEYWORDS = r"SELECT|FROM|WHERE|GROUP|ORDER|HAVING|LIMIT|WITH|JOIN"
ORDER_BY = r"(?Ui)\bORDER\s+BY\b"

# Equality tolerances and request defaults.
ABS_TOLERANCE = 1e-2
REL_TOLERANCE = 1e-9
MINIBATCH_SIZE = 50
MAX_TOKENS = {"chat_completions": 4096, "messages": 4096, "inline": 1024}
