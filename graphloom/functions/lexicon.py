"""Fixed values the results depend on.

Everything in this module is a constant that must equal the behaviour being
reproduced (annotation names, stop words, blocked suffixes, analyzer patterns).
It holds no logic.
"""
from __future__ import annotations

# --- fixed values: Java lexing --------------------------------------------
# One match = (whitespace / comments)* followed by one significant token, or
# the trailing whitespace at end of input.  All loops are possessive so that a
# long comment or literal is matched iteratively (no regex recursion).
JAVA_TOKEN = (
    r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|[\p{L}_$][\p{L}\p{N}_$]*+"
    r"|\p{N}[\p{L}\p{N}_.]*+"
    r"|."
)
JAVA_LEXER = r"(?s)((?:\s++|//[^\n]*+|/\*.*?\*/)*+)(" + JAVA_TOKEN + r"|\z)"

# --- fixed values: annotation names ---------------------------------------
STEREOTYPES = ["RestController", "Controller", "Service", "Repository", "Component"]
HTTP_MAPPINGS = ["GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "RequestMapping"]
AUTOWIRED = "Autowired"

# --- fixed values: Java keywords used by the extraction rules -------------
# identifiers followed by "(" that are never a method invocation
CALL_KEYWORDS = [
    "if", "for", "while", "switch", "catch", "synchronized", "return", "throw",
    "this", "super", "try", "assert", "case", "new", "instanceof",
    "do", "else",
]
# words that are keywords only where no "." stands before them
CONTEXT_KEYWORDS = ["yield"]
# declaration modifiers (never a type)
MODIFIERS = [
    "public", "private", "protected", "static", "final", "abstract", "native",
    "synchronized", "transient", "volatile", "strictfp", "default", "sealed",
]
# reserved words that cannot end a type (primitive types and void can)
NON_TYPE_KEYWORDS = sorted(set(CALL_KEYWORDS + CONTEXT_KEYWORDS + MODIFIERS + [
    "package", "import", "class", "interface", "enum", "extends", "implements",
    "throws", "break", "continue", "finally", "goto", "const", "null", "true",
    "false", "permits",
]))

# --- fixed values: question key terms --------------------------------------
STOP_WORDS = [
    "how", "does", "what", "is", "the", "a", "an", "in", "on", "at",
    "to", "for", "of", "and", "or", "where", "which", "who", "when",
    "do", "did", "can", "could", "would", "should", "work", "works",
    "get", "find", "show", "tell", "me", "i", "we", "use", "used",
    "with", "from", "this", "that", "are", "was", "be", "been", "by",
]
MAX_KEY_TERMS = 3
SEARCH_TOP_K = 5
MAX_CHAIN_METHODS = 5
MAX_LISTED_METHODS = 15

# --- fixed values: search --------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
# "standard": letters/digits/underscore runs, joined across a single . or '
# when word characters are on both sides (a.b stays one term).
ANALYZER_STANDARD = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"
# "code": split at every non-word character, so svc.register gives register.
ANALYZER_CODE = r"[\p{L}\p{N}_]+"
ANALYZERS = {"standard": ANALYZER_STANDARD, "code": ANALYZER_CODE}

# --- fixed values: write policy --------------------------------------------
BLOCKED_SUFFIXES = [".env", ".key", ".pem", ".p12", ".pfx", ".jks"]
BLOCKED_NAME = ".env"
VCS_DIR = ".git"
STALE_SUFFIX = ".java"

# --- fixed values: messages ------------------------------------------------
MSG_NO_TERMS = (
    "Could not extract key terms from question. "
    "Try being more specific, e.g. 'How does beneficiary registration work?'"
)
MSG_NO_HITS_PREFIX = "No methods found in the graph for terms: "
MSG_NO_HITS_SUFFIX = ". Try re-running ingestion or use search_code with a different term."
MSG_NO_CALLS = "    (no outgoing calls recorded or not yet indexed)"
MSG_NOTE = "NOTE: Re-run ingestion if recently written files are missing from results."
MSG_OUTSIDE = ("Path ", " is outside allowed roots.")
MSG_BLOCKED = ("Writing to ", " is blocked.")
MSG_VCS = "Writing inside .git is blocked."
MSG_INVALID_PATH = "Invalid path"
MSG_FILE_NOT_FOUND = "ERROR: File not found: "
MSG_STALE = " — re-run ingestion to sync."
