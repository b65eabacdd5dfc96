"""Constants that define the measures: languages, scripts, English word lists, bands and weights.

Fixed values: changing one changes what a score means.
"""

from __future__ import annotations

# Fixed values. Languages: code, name, script, whether a danda may end a sentence.
LANGUAGES: list[tuple[str, str, str, bool]] = [
    ("hi", "Hindi", "Devanagari", True),
    ("bn", "Bengali", "Bengali", True),
    ("mr", "Marathi", "Devanagari", True),
    ("te", "Telugu", "Telugu", False),
    ("ta", "Tamil", "Tamil", False),
    ("gu", "Gujarati", "Gujarati", True),
    ("kn", "Kannada", "Kannada", False),
    ("ml", "Malayalam", "Malayalam", False),
    ("pa", "Punjabi", "Gurmukhi", True),
    ("or", "Odia", "Oriya", True),
    ("as", "Assamese", "Bengali", True),
    ("ur", "Urdu", "Arabic", False),
    ("sa", "Sanskrit", "Devanagari", True),
    ("ne", "Nepali", "Devanagari", True),
    ("kok", "Konkani", "Devanagari", True),
    ("mai", "Maithili", "Devanagari", True),
    ("doi", "Dogri", "Devanagari", True),
    ("brx", "Bodo", "Devanagari", True),
    ("sd", "Sindhi", "Arabic", False),
    ("ks", "Kashmiri", "Arabic", False),
    ("mni", "Manipuri", "MeiteiMayek", False),
    ("sat", "Santali", "OlChiki", False),
    ("hinglish", "Hinglish", "Latin", False),
]

# Fixed values. Scripts as inclusive ranges of code points.
SCRIPT_RANGES: dict[str, tuple[int, int]] = {
    "Devanagari": (0x0900, 0x097F),
    "Bengali": (0x0980, 0x09FF),
    "Gurmukhi": (0x0A00, 0x0A7F),
    "Gujarati": (0x0A80, 0x0AFF),
    "Oriya": (0x0B00, 0x0B7F),
    "Tamil": (0x0B80, 0x0BFF),
    "Telugu": (0x0C00, 0x0C7F),
    "Kannada": (0x0C80, 0x0CFF),
    "Malayalam": (0x0D00, 0x0D7F),
    "Arabic": (0x0600, 0x06FF),
    "OlChiki": (0x1C50, 0x1C7F),
    "MeiteiMayek": (0xABC0, 0xABFF),
    "Latin": (0x0041, 0x007A),
}

# Fixed values. Whose word lists a language without its own uses.
SCRIPT_FAMILY: dict[str, str] = {
    "hi": "hi", "mr": "mr", "sa": "hi", "ne": "hi", "kok": "hi", "mai": "hi", "doi": "hi", "brx": "hi",
    "bn": "bn", "as": "bn", "gu": "gu", "pa": "pa", "ta": "ta", "te": "te", "kn": "kn",
    "ml": "ml", "or": "or", "ur": "ur", "sd": "ur", "ks": "ur", "mni": "bn", "sat": "sat",
    "hinglish": "hinglish",
}

#: Languages whose bands were measured.
CALIBRATED = ("en", "hi")

# Fixed values. Romanised function words that tell Hinglish from English.
HINGLISH_MARKERS = [
    "hai", "hain", "nahi", "nahin", "aur", "kya", "kar", "ke liye", "karna",
    "wala", "bahut", "mein", "yeh", "woh", "aap", "hum", "kaise", "kyun",
]

# Fixed values. English filler phrases.
FILLER = [
    "it is important to note", "it should be noted", "in today's fast-paced", "in this day and age", "when it comes to",
    "at the end of the day", "needless to say", "it goes without saying", "the fact of the matter", "in order to",
    "due to the fact that", "a wide range of", "plays a vital role", "plays a crucial role", "in conclusion",
    "last but not least", "first and foremost",
]

# Fixed values. English stock phrases.
TELLS = [
    "moreover", "furthermore", "additionally", "in conclusion", "it is important to note", "delve into", "navigate the",
    "tapestry", "in the realm of", "unlock the", "harness the power", "in summary", "on the other hand", "as a result",
    "underscore", "testament to", "boasts a", "elevate your", "seamless", "robust", "cutting-edge",
]

# Fixed values. (parameter, good, bad, lower is better, weight).
ENGLISH_BANDS = [
    ("para_cv", 0.18, 0.02, False, 0.30),
    ("tell_1k", 0.00, 5.00, True, 0.30),
    ("colon_lists_1k", 0.00, 5.00, True, 0.25),
    ("passive_ratio", 0.28, 0.04, False, 0.15),
]
INDIC_BANDS = [
    ("sp_punct_1k", 0.5, 29.8, True, 0.25),
    ("prep_calque_1k", 0.4, 10.7, True, 0.25),
    ("rel_1k", 0.4, 3.7, True, 0.25),
    ("comma_1k", 22.0, 72.0, True, 0.25),
]
#: A parameter passes from this score on.
TARGET = 70.0
#: Measured, and left out of the objective.
NOT_CHASED = ("passive_ratio",)
#: Fewer words than this give no verdict; bands end at these likenesses.
LEAST_WORDS, HUMAN_TO, MIXED_TO = 120, 30, 60

# Fixed values. Words that mark a claim as uncertain, and classes of equally uncertain ones.
HEDGES: dict[str, list[str]] = {
    "en": [
        "may", "might", "could", "possibly", "reportedly", "appears to", "seems to", "suggests", "is associated with",
        "is linked to", "some studies", "preliminary", "in some cases", "generally", "typically", "often", "can help",
        "is thought to", "believed to", "potentially", "up to", "about", "approximately", "around",
    ],
    "hi": [
        "हो सकता है", "हो सकती है", "संभवतः", "शायद", "आमतौर पर", "कुछ मामलों में", "माना जाता है",
        "अध्ययनों के अनुसार", "लगभग", "करीब", "मदद कर सकता है",
    ],
}
HEDGE_CLASSES = [
    ["may", "might", "could", "can"],
    ["suggests", "indicates", "points to"],
    ["is associated with", "is linked to", "correlates with"],
    ["appears to", "seems to"],
    ["approximately", "about", "around", "roughly"],
]

# Fixed values. Verbs whose claims must keep their hedges.
CLAIM_VERBS = [
    "reduce", "reduces", "increase", "increases", "improve", "improves", "cure", "cures", "prevent", "prevents",
    "lower", "lowers", "raise", "raises", "eliminate", "eliminates", "treat", "treats", "boost", "boosts",
]

# Fixed values. Openers that are deleted, phrases that are replaced, phrases that are only reported.
OPENERS = [
    "moreover", "furthermore", "additionally", "in conclusion", "in summary", "notably", "importantly", "needless to say",
    "it goes without saying", "last but not least", "first and foremost", "at the end of the day",
]
REPLACEMENTS = [
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("despite the fact that", "although"),
    ("in the event that", "if"),
    ("a wide range of", "many"),
    ("as a result", "so"),
    ("the fact of the matter is that", ""),
    ("it should be noted that", ""),
    ("it is important to note that", ""),
]
SUGGESTIONS = [
    "tapestry", "seamless", "robust", "cutting-edge", "delve into", "navigate the", "in the realm of", "unlock the",
    "harness the power", "elevate your", "testament to", "boasts a", "underscore",
]
#: What the clean-up declines to touch.
REFUSALS = ["comma_1k", "rel_1k", "colon_lists_1k", "para_cv", "passive_ratio"]

# Fixed values. First code point of each block of ten digits that is folded to ASCII.
DIGIT_ZEROS = [0x30, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660]

# Fixed values. Protected spans, most specific first, with \w, \d and \b for ASCII and \s for all white space.
SPANS = [
    ("url", r"https?:\/\/[^\s<>\"')\]]+"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("phone", r"(?:\+91[\s-]?)?[6-9]\d{9}\b"),
    ("dosage", r"(?i)\d+(?:[.,]\d+)?\s*(?:mg|ml|mcg|gm|kg|g|IU|mmol|mIU)\b"),
    ("price", r"(?i)(?:₹|Rs\.?|INR)\s*\d[\d,]*(?:\.\d+)?"),
    ("percent", r"\d+(?:\.\d+)?\s*%"),
    ("number", r"\b\d+(?:[.,]\d+)*\b"),
]
#: Brackets around the number of a masked span.
MASK_OPEN, MASK_CLOSE = "⪉", "⪊"

# Fixed values. Sentence run-ups, nominal endings, contractions and words of address.
RUN_UPS = (
    r"based on|from an?|in light of|given|considering|regarding|in terms of|with regard|as (?:the|a)\b|through|by |when |while |"
    r"following|understanding|overall|ultimately|importantly|notably|prompt|according to|due to|owing to|in addition|beyond"
)
NOMINAL_ENDINGS = "tion|ment|ance|ence|ity|ness|ency"
CONTRACTION_ENDINGS = "t|re|ve|ll|d|m"
ADDRESS_WORDS = "I|we|you|our|your|us|my|me|I'm|we're|you're"
BE_AND_GET = "is|are|was|were|be|been|being|get|gets|got"
PARTICIPLE_ENDINGS = "ed|en|wn|ne"

# Fixed values. Elements that hold no article, and where an article is looked for first.
NO_CONTENT_TAGS = ["script", "style", "noscript", "nav", "footer", "aside", "form", "iframe", "svg", "button", "template"]
NO_CONTENT_ROLES = ["navigation", "banner", "complementary"]
NO_CONTENT_CLASSES = ["nav", "menu", "sidebar", "comments", "advertisement", "ad", "cookie", "newsletter", "related", "share", "breadcrumb"]
ARTICLE_PLACES = [("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "post-content"), ("class", "entry-content"), ("class", "article-body"), ("id", "content")]
