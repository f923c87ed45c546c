"""Fixed values.

Everything in this module is a constant that results depend on: patterns,
messages, limits and defaults. They are stated here once, as plain text.
"""

# Whitespace as Python's str.strip and str.split see it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a Java regular expression, under the U flag.
WS_CLASS = r"\s\x1c-\x1f"

# Page boilerplate (Java flags: i = any case, u = Unicode case, d = only \n ends a line).
APPROVAL_LINE = r"(?iud)Revision Date Approved by:.*?(?:\n|$)"
MANUAL_TITLE = rf"(?iuU)Laboratory Safety Manual[{WS_CLASS}]*"
BLANK_LINE_RUN = r"\n{3,}"
# A lower-cased page without these, and without three line ends in a row, matches none of the
# three. They have none of the letters that other characters equal in another case (i, k, s).
APPROVAL_PART = "on date approved by:"
MANUAL_PART = "ety manual"

# Section headers: numbered title, SECTION x, APPENDIX x, or a line of capitals.
SECTION_HEADER = (
    rf"(?U)^(\d+(\.\d+)*[{WS_CLASS}]+[A-Z0-9{WS_CLASS}\-/]{{3,}}"
    rf"|SECTION[{WS_CLASS}]+[A-Z0-9]+"
    rf"|APPENDIX[{WS_CLASS}]+[A-Z0-9\:{WS_CLASS}]+"
    rf"|[A-Z{WS_CLASS}]{{4,}})"
)
HEADER_LINES = 5
HEADER_MIN_LENGTH = 4
HEADER_MAX_LENGTH = 90
PAGE_WORD = "page"
SECTION_FALLBACK = "General Section"
SECTION_INITIAL = "General Overview"
SECTION_DEFAULT = "General"

# Splitting.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")
CHUNK_HASH_LENGTH = 12

# Embedding.
EMPTY_TEXT = "empty"
EMBEDDING_SIZE = 768

# Retrieval.
TOP_K_DEFAULT = 4
TOP_K_MIN = 1
TOP_K_MAX = 10
FETCH_FACTOR = 2
DISTANCE_THRESHOLD = 0.55
DISTANCE_DECIMALS = 4
DOCUMENT_DEFAULT = "Unknown SOP"
PAGE_DEFAULT = 1
CATALOG_DEFAULT = "Unknown"
SNIPPET_LENGTH = 240
SNIPPET_TAIL = "..."
CONTEXT_BLOCK = "[%d] Document: %s | Section: %s | Page: %d\nExcerpt: %s\n"

# Answers.
ANSWER_EMPTY_INDEX = (
    "No Standard Operating Procedures (SOPs) have been indexed yet. "
    "Please trigger an ingestion scan first."
)
ANSWER_NO_CONTEXT = "I don't know based on the provided documents."
ANSWER_FAILURE = "Inference engine failure: "
REFERENCES_TAIL = r"(?iuU)\n(?:\*\*|##|\b)?References(?:\:|\*\*|\b)?"
CITATION_MARK = r"(?U)\[(\d+)\]"
CITATION_SUPERSCRIPT = "<sup>[$1]</sup>"

# Prompt.
SYSTEM_INSTRUCTION = (
    "You are an expert enterprise AI assistant for technical documentation and SOPs.\n"
    "Your mission is to provide exceptionally clear, beautifully structured answers strictly based on the provided context.\n\n"
    "MANDATORY FORMATTING & CITATION RULES:\n"
    "1. STRUCTURE & READABILITY:\n"
    "   - Format explanations cleanly using structured bullet points, numbered steps, and bold key terms.\n"
    "   - Avoid dense paragraph walls of text.\n"
    "2. CODE & QUERIES:\n"
    "   - Format ANY SQL queries, JQL expressions, scripts, or commands in proper fenced code blocks (e.g. ```sql, ```jql, ```bash).\n"
    "   - NEVER embed multi-part code inside long sentences.\n"
    "3. CITATIONS:\n"
    "   - Cite your sources with bracketed numbers like [1], [2] immediately following the statement or fact.\n"
    "   - Do NOT write raw filenames, URLs, or section titles in the body text.\n"
    "   - Do NOT add a bibliography or sources section at the end (the UI renders this automatically).\n"
    "4. ACCURACY GUARDRAIL:\n"
    "   - If the context does not contain enough information to answer the question, state EXACTLY:\n"
    "     \"I don't know based on the provided documents.\""
)
PROMPT_HEAD = "REFERENCE CONTEXT:\n"
PROMPT_QUESTION = "\nUSER QUESTION:\n"
PROMPT_TAIL = (
    "\n\nProvide a structured, beautifully formatted answer with code blocks "
    "and inline [1], [2] citations:"
)

# Answer cache.
CACHE_TTL_SECONDS = 3600
CACHE_LIMIT = 500
CACHE_EVICT = 100

# File payloads and scan status.
PDF_SUFFIX = ".pdf"
PAYLOAD_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
STATUS_DEFERRED = "Scan deferred: Python AI engine is currently unreachable."
STATUS_ERROR = "Error during scheduled scan: %s"
STATUS_UP_TO_DATE = "Scan completed: Knowledge base is up to date (no new/modified PDFs)."
STATUS_DONE = "Scan completed successfully: %d/%d documents synchronized."
STATUS_MANUAL_ABORTED = "Manual scan aborted: Python AI engine is offline."
STATUS_MANUAL_DONE = "Manual scan completed: %d/%d documents dispatched."
