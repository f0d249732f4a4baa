"""Fixed values that results depend on: word lists, markers, patterns and constants."""

# --- fixed values: English words that frame a question and carry no content ---
ENGLISH_QUESTION_WORDS = (
    "what", "when", "how", "where", "who", "why", "which", "whose", "is", "are", "am", "was", "were", "be", "do",
    "does", "did", "can", "could", "should", "would", "will", "the", "a", "an", "i", "you", "me", "my", "your",
    "of", "to", "for", "in", "on", "tell", "show", "give", "explain", "about", "please", "s", "it", "this", "that",
    "there", "here", "and", "or", "not", "with", "from", "at", "by", "as", "if", "so", "have", "has",
)

# --- fixed values: Hangul particles tried as suffixes, longest first when applied ---
KOREAN_PARTICLES = (
    "이랑", "랑", "이라고", "라고", "이라는", "라는", "이라", "라", "이니까", "니까", "이네요", "네요", "이야", "야", "이나", "나",
    "으로써", "로써", "으로서", "로서", "으로", "로", "은", "는", "이", "가", "을", "를", "과", "와",
    "에서", "에게", "한테", "부터", "까지", "마다", "보다", "처럼", "에", "의", "도", "만",
)

# --- fixed values: leading fillers per language used by the sample packs ---
FILLER_HEADS = ["well", "so", "um", "uh", "okay", "hey", "저기요", "음", "그"]

# --- fixed values: number scale words and their factors ---
NUMBER_SCALES = {"조": 10**12, "억": 10**8, "만": 10**4, "천": 10**3, "백": 10**2, "십": 10}

# --- fixed values: routing constants ---
ROUTE_THRESHOLD = 0.43
FRAGMENT_WEIGHT = 0.90
LANGUAGE_PENALTY = 0.85
SUPPORT_WEIGHT = 0.12
USAGE_WEIGHT = 0.05
RARE_WEIGHT = 0.20
RARE_MAX_SOURCES = 2
RARE_CAP = 3
SHORT_LINE = 8
LONG_QUESTION_SCALE = 2.0

# --- fixed values: verdict thresholds used where a graph declares none ---
A_MIN = 0.45
OK_MIN = 0.58

# --- fixed values: decay constants (activation per turn, usage per grounded answer) ---
ACTIVATION_DECAY = 0.75
ACTIVATION_BONUS = 0.15
USAGE_DECAY = 0.98
DECAY_FLOOR = 0.02

# --- fixed values: HTML elements whose content is dropped, and elements that end a block ---
HTML_DROP = ["script", "style", "noscript", "svg", "canvas", "nav", "footer", "header", "form"]
HTML_BLOCK = ["p", "article", "section", "main", "h1", "h2", "h3", "li", "blockquote"]
HTML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ",
                 "&copy;": "©", "&middot;": "·", "&amp;": "&"}

# White space as in Unicode-aware regular expressions, spelled so that Java and RE2 agree.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD_BREAK = r"[^\p{L}\p{N}]+"
