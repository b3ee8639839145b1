"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced for results to match: keyword lists, patterns, shares, seeds and
message templates.  They are stated plainly, in their natural order, and are
not derived or rearranged.  Lists whose order matters (skills are reported in
list order, origin lists are tested in order) keep that order.
"""

# --------------------------------------------------------------------------
# FIXED VALUES: document parser (per-document extraction rules)
# --------------------------------------------------------------------------

# Patterns of the cleaning and extraction rules.
# Python's str.isspace() set, as a regex class body.
WS = (r"\x{09}-\x{0D}\x{20}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"

EMAIL_RE = rf"[{WORD}.+-]+@[{WORD}.-]+\.[{WORD}]+"
STRIP_RE = rf"^[{WS}]+|[{WS}]+$"
TAG_RE = r"<[^>]+>"
URL_RE = rf"http[^{WS}]+|www\.[^{WS}]+"
WS_RUN_RE = rf"[{WS}]+"
NON_ASCII_RE = r"[^\x{00}-\x{7F}]+"

# Skills reported by the parser, in reporting order (lower-case substring test).
PARSER_SKILLS = [
    "python", "java", "sql", "react", "aws", "tensorflow", "pytorch",
    "pandas", "kubernetes", "docker", "machine learning", "deep learning",
    "nlp", "natural language processing", "scikit-learn", "data science",
    "rest api", "node.js", "vue.js", "mongodb", "statistics",
    "data analysis", "tableau", "excel", "git", "keras", "bert",
    "transformers", "spacy", "nltk", "tf-idf", "logistic regression",
    "random forest", "neural network", "computer vision", "microservices",
]

# Institution keywords giving "Tier 1" (lower-case substring test).
PARSER_TIER1 = [
    "mit", "stanford", "oxford", "cambridge", "harvard",
    "imperial", "eth zurich", "iit", "edinburgh", "birmingham",
]

# Name-origin lists, tested in this order on the lower-cased name.
PARSER_SOUTH_ASIAN = [
    "sharma", "patel", "singh", "kumar", "gupta", "rao",
    "ali", "khan", "ahmed", "hassan", "farhan", "al-",
]
PARSER_WESTERN = [
    "johnson", "mitchell", "smith", "jones", "williams",
    "brown", "taylor", "wilson", "anderson", "thomas",
]

# Degree keywords; the first line containing one (case-insensitive substring)
# is the education line.
EDUCATION_KEYWORDS = [
    "B.Tech", "M.Tech", "MBA", "B.Sc", "M.Sc", "Bachelor",
    "Master", "PhD", "MCA", "BSc", "MSc", "B.E",
]

# Career-gap patterns of the parser; "." is any character except a newline.
PARSER_GAP_PATTERNS = [
    "career.break", "career.gap", "caregiving",
    "maternity", "parental.leave", "took.time.off",
]

# Gender proxy of the parser: female pattern is tested first, then male.
PARSER_FEMALE_PATTERN = "she/her|maternity|caregiving"
PARSER_MALE_PATTERN = "he/him"

# --------------------------------------------------------------------------
# FIXED VALUES: corpus preparation job (whole-text rules)
# --------------------------------------------------------------------------

PREP_TIER1 = [
    "iit", "iim", "mit ", "stanford", "oxford", "cambridge",
    "harvard", "imperial", "nit ", "bits pilani", "delhi university",
    "jadavpur", "anna university",
]

# Regex patterns; "\s" here means Python's Unicode whitespace.
PREP_GAP_PATTERNS = [
    r"career\s+break", r"career\s+gap", r"employment\s+gap",
    r"sabbatical", r"caregiving", r"maternity", r"parental\s+leave",
    r"took\s+time\s+off", r"left\s+the\s+workforce",
    r"gap\s+year", r"freelance.*break",
]

# Whole-word gender cues, female tested first.
PREP_FEMALE_WORDS = ["she", "her", "maternity", "caregiving"]
PREP_MALE_WORDS = ["he", "him", "his"]

PREP_SOUTH_ASIAN = [
    "sharma", "patel", "singh", "kumar", "gupta", "rao",
    "mishra", "joshi", "verma", "reddy", "nair", "iyer",
    "bhat", "ali", "khan", "ahmed", "hassan", "hussain",
    "siddiqui", "chaudhary", "kapoor",
]
PREP_WESTERN = [
    "smith", "jones", "williams", "brown", "taylor",
    "johnson", "wilson", "anderson", "thomas", "jackson",
    "white", "harris", "martin", "thompson", "moore",
    "robinson", "clark", "lewis", "lee", "walker",
]
PREP_EAST_ASIAN = [
    "chen", "wang", "li ", "zhang", "liu", "yang", "huang",
    "zhao", "wu ", "zhou", "kim", "park", "lee ", "nguyen",
    "tran", "pham", "tanaka", "yamamoto", "sato",
]

# Fallback origin buckets (index = hash bucket of the first 50 characters).
ORIGIN_BUCKETS = ["South Asian proxy", "Western proxy", "East Asian proxy"]
ORIGIN_PREFIX_CHARS = 50

PREP_SKILLS = [
    "python", "java", "sql", "machine learning", "deep learning",
    "nlp", "pandas", "scikit-learn", "tensorflow", "pytorch",
    "rest api", "git", "docker", "aws", "data analysis",
    "statistics", "tableau", "spark", "hadoop", "r programming",
    "data science", "neural network", "computer vision", "spacy",
    "nltk", "bert", "transformers", "flask", "django", "react",
    "node.js", "mongodb", "postgresql", "kubernetes", "excel",
]

# Rebalancing shares (truncated to an integer count).
GAP_TARGET_SHARE = 0.15
GENDER_FEMALE_SHARE = 0.50
GENDER_MALE_SHARE = 0.45
ORIGIN_TO_WESTERN_SHARE = 0.30
ORIGIN_TO_EAST_ASIAN_SHARE = 0.15

MIN_CLEAN_LENGTH = 100          # keep rows with length(clean) > 100
SEED = 42

# Synthetic identity formats (1-based position).
NAME_FORMAT = "Candidate_%03d"
EMAIL_FORMAT = "candidate%d@resume.kaggle"
FILE_FORMAT = "resume_%03d.txt"

# --------------------------------------------------------------------------
# FIXED VALUES: group labels
# --------------------------------------------------------------------------

TIER1_LABEL = "Tier 1"
TIER23_LABEL = "Tier 2/3"
GAP_YES = "Yes"
GAP_NO = "No"
GAP_SYNTHETIC = "Yes (synthetic)"
FEMALE = "Female proxy"
MALE = "Male proxy"
UNSPECIFIED = "Unspecified"
FEMALE_SYNTHETIC = "Female proxy (synthetic)"
MALE_SYNTHETIC = "Male proxy (synthetic)"
SOUTH_ASIAN = "South Asian proxy"
WESTERN = "Western proxy"
EAST_ASIAN = "East Asian proxy"
OTHER = "Other"
WESTERN_SYNTHETIC = "Western proxy (synthetic)"
EAST_ASIAN_SYNTHETIC = "East Asian proxy (synthetic)"
UNKNOWN_NAME = "Unknown"

# Audit attributes, in audit order.
AUDIT_ATTRIBUTES = ["gender_proxy", "institution_tier", "career_gap", "name_origin_proxy"]
SEVERITY = ["Highest", "Moderate", "Lower"]   # position 1, position 2, the rest

# --------------------------------------------------------------------------
# FIXED VALUES: vectorizer, model, explainers
# --------------------------------------------------------------------------

MAX_FEATURES = 500
SCORE_DECIMALS = 4
REC_RATE_DECIMALS = 3
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 1000

TOP_CLEAN_TERMS = 10        # clean terms kept per document
TOP_TABLE_TERMS = 6         # of those, shown in the table (4 dp)
TOP_BIAS_TERMS = 3          # noise terms in the bias note (5 dp)
BIAS_MIN_ABS = 1e-6
CONTRAST_TERMS = 3

# Noise terms: 4-digit years starting 19/20, anything with "@", or containing
# one of these words.
NOISE_YEAR_RE = r"^(19|20)\p{Nd}{2}$"
NOISE_WORDS = [
    "email", "phone", "address",
    "experience", "education", "skills",
    "years", "work", "team", "using",
]

# Local perturbation explainer.
PERTURB_SAMPLES = 100
PERTURB_FEATURES = 10
KERNEL_WIDTH = 25.0
SELECT_RIDGE_ALPHA = 0.01
FINAL_RIDGE_ALPHA = 1.0

HELPED = "↑ Helped"
HURT = "↓ Hurt"
RECOMMENDED_TEXT = "✓ Recommended"
NOT_RECOMMENDED_TEXT = "✗ Not recommended"

# Contrast sentences.  {name} is the document name, {f0}.. the gap terms.
CONTRAST_IMPROVE = "To improve {name}'s ranking, stronger presence of **{f0}** would help most"
CONTRAST_FOLLOWED = ", followed by **{f1}**"
CONTRAST_AND = " and **{f2}**"
CONTRAST_QUESTION = (
    ".\n\n*Research question: Is the absence of '{f0}' a genuine skill gap "
    "— or an artefact of how {name} described their experience?*"
)
CONTRAST_NO_GAP = "{name} scored lower due to a different technical focus area."
CONTRAST_LEADER = "{name} is the top-ranked candidate. Key skill signals: "
CONTRAST_LEADER_GENERIC = "strong overall keyword alignment with the job description"
