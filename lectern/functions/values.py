"""Values that results depend on."""

# Phrases of page furniture, matched as substrings of short lower-cased blocks.
BOILERPLATE = [
    "share this", "share on", "follow us", "sign up for", "sign up to", "subscribe to", "subscribe now", "newsletter",
    "related articles", "related stories", "read more", "more from", "most read", "most popular", "you might also like",
    "recommended for you", "all rights reserved", "terms of service", "privacy policy", "cookie", "accept all",
    "advertisement", "sponsored content", "log in", "sign in", "register now", "view image in fullscreen", "photograph:",
    "photo:", "image:", "credit:", "illustration:", "getty images", "skip to content", "back to top",
    "this article was amended", "do not sell my personal information", "comments (", "leave a comment", "about the author",
]

# Abbreviations whose full stop never ends a sentence.
NEVER_END = [
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Rev.", "Fr.", "Sr.", "Jr.", "St.", "Hon.", "Gen.", "Col.", "Lt.", "Sgt.", "Capt.",
    "Adm.", "Gov.", "Sen.", "Rep.", "Pres.",
    "e.g.", "i.e.", "cf.", "vs.", "v.", "viz.", "etc.", "al.", "ibid.", "op.", "cit.", "ca.", "approx.",
    "Fig.", "Figs.", "Tab.", "No.", "Nos.", "Vol.", "Vols.", "p.", "pp.", "ch.", "Ch.", "Sec.", "Eq.", "Ref.", "Refs.", "Ed.", "Eds.", "trans.",
    "Inc.", "Ltd.", "Co.", "Corp.", "Dept.", "Univ.", "Assn.",
    "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.",
    "Mon.", "Tue.", "Tues.", "Wed.", "Thu.", "Thur.", "Thurs.", "Fri.", "Sat.", "Sun.",
    "a.m.", "p.m.",
]

# Tokens spelled letter by letter.
SPELL_OUT = (
    "US USA UK EU UN AI ML API URL URI HTTP HTTPS SQL CSS HTML XML JSON PDF CPU GPU RAM SSD USB OS IP DNS "
    "CEO CFO CTO COO HR PR IT UI UX MP NHS BBC ITV FBI CIA IRS FDA GDP CPI ID DNA RNA HIV AGM CV"
).split()

# Characters repaired before anything else.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\ufeff"
SPACES = "\u00a0\u2007\u2009\u202f\u2028"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„″"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]+"
BULLETS = "•‣▪◦⁃·"

# Expansions, in order.
EXPANSIONS = [
    (r"(?iu)\bet\s+al\.(?=\s|$|,)", "and others"),
    (r"(?iu)\be\.\s?g\.(?=\s|$|,)", "for example"),
    (r"(?iu)\bi\.\s?e\.(?=\s|$|,)", "that is"),
    (r"(?iu)\betc\.(?=\s|$|,)", "et cetera"),
    (r"(?iu)\bcf\.(?=\s|$|,)", "compare"),
    (r"(?iu)\bvs?\.(?=\s)", "versus"),
    (r"(?iu)\bapprox\.(?=\s|$)", "approximately"),
    (r"\bFigs\.(?=\s*\d)", "Figures"),
    (r"\bFig\.(?=\s*\d)", "Figure"),
    (r"\bNos\.(?=\s*\d)", "Numbers"),
    (r"\bNo\.(?=\s*\d)", "Number"),
    (r"\bpp\.(?=\s*\d)", "pages"),
    (r"\bp\.(?=\s*\d)", "page"),
    (r"(?<=\d)\s*%", " percent"),
    (r"(?<=\s)&(?=\s)", "and"),
    (r"§\s*(?=\d)", "section "),
    (r"(?<=\d)\s*°", " degrees"),
    (r"±", "plus or minus"),
    (r"≈", "approximately"),
    (r"×", "by"),
    (r"(?<=\d)\s*–\s*(?=\d)", " to "),
]
# What any text holds in which an expansion, an address or a protected token is found.
MAY_EXPAND = r"[%&§°±×]|[≈–]|\.(?i:(?<=\sal\.|\betc\.|\bcf\.|\bapprox\.|\bvs?\.|\bfigs?\.|\bnos?\.|\bpp?\.)|(?<=\be\.)(?=\s?g\.)|(?<=\bi\.)(?=\s?e\.))"
MAY_LINK = r"://|\.(?iu:com|org|net|edu|gov|io|co\.uk)|(?iu:www)\."
MAY_PROTECT = r"\d|\.(?iu:pdf|htm|txt|md|py|js|csv|json|xml|zip)"
EMAIL = r"\{[^{}\s]+\}@[\w.-]+\.\w{2,}|[\w.+-]+@[\w.-]+\.\w{2,}"
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'\)\]]+|\b[\w.-]+\.(?:com|org|net|edu|gov|io|co\.uk)(?:/[^\s<>\"'\)\]]*)?"

# What no expansion may touch.
PROTECTED = [
    r"\bv\d+(?:\.\d+)+\b",
    r"\b\d+\.\d+\.\d+\b",
    r"\b\d{4}\.\d{4,5}\b",
    r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    r"(?i)\b\d{1,2}\.\d{2}\s?[ap]\.?m\.?\b",
    r"\b\d+-\d+\b",
    r"\b[A-Za-z]+-\d+[A-Za-z0-9.]*\b",
    r"(?i)\b\w+\.(?:pdf|html?|txt|md|py|js|csv|json|xml|zip)\b",
]

# Citation markers, page numbers, stamps, implausible authors, captions.
BRACKET_CITATION = r"(?i)\s*\[\s*(?:\d+(?:\s*[,–-]\s*\d+)*|[a-z]|note\s*\d+|nb\s*\d+)\s*\]"
SUPERSCRIPTS = "[¹²³⁰-⁹]+"
AUTHOR_YEAR = (
    r"\s*\((?:see\s+)?(?:e\.g\.,?\s*)?[A-Z][A-Za-z'’-]+(?:\s+(?:et\s+al\.|and|&)\s*[A-Za-z'’-]*)?(?:,)?\s*\d{4}[a-z]?"
    r"(?:\s*;\s*[A-Z][A-Za-z'’-]+(?:\s+(?:et\s+al\.|and|&)\s*[A-Za-z'’-]*)?(?:,)?\s*\d{4}[a-z]?)*\)"
)
PAGE_NUMBER = r"(?i)^[\s\-–—|]*(?:page\s+)?([0-9]{1,4}|[ivxlcdm]{1,7})[\s\-–—|]*$"
STAMP = (
    r"(?i)^\s*(?:arXiv:\s?\d{4}\.\d{4,5}|doi:\s?10\.\d{4}|https?://doi\.org/|preprint\b|under review\b|to appear in\b"
    r"|licen[cs]ed under\b|this work is licen[cs]ed\b|permission to make digital\b)"
)
JUNK_AUTHOR = r"(?i)authority control|wikipedia|contributors|editorial|editors of|staff writer|admin|newsroom|^by\b|\bstaff$|guest (?:author|writer)"
CAPTION = r"(?i)^\s*(figure|fig\.?|table|chart|plate|exhibit|scheme)\s*\d+[.:)]?\s"

# Signs of a paywall, in report order, after the schema.org flag and before the content tier.
PAYWALL = [
    "paywall", "regwall", "meteredcontent", "metered-content", "subscription-required", "subscriber-only", "premium-content",
    "piano-", "tp-modal", "gate-container", "article-gate",
]

ORDINALS = [
    "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen", "Fourteen",
    "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen", "Twenty",
]

# Voices of the ONNX engine in order of preference within (accent, gender): id, grade.
ACCENTS = {"us": "American", "uk": "British", "au": "Australian", "ie": "Irish", "in": "Indian", "za": "South African", "nz": "New Zealand", "ca": "Canadian"}
NEAREST = {"au": "uk", "nz": "uk", "ie": "uk", "za": "uk", "in": "uk", "ca": "us"}
VOICES = [
    ("af_heart", "us", "female", "A"), ("af_bella", "us", "female", "A-"), ("af_nicole", "us", "female", "B-"), ("af_aoede", "us", "female", "C+"),
    ("af_kore", "us", "female", "C+"), ("af_sarah", "us", "female", "C+"), ("af_alloy", "us", "female", "C"), ("af_nova", "us", "female", "C"),
    ("af_sky", "us", "female", "C-"), ("af_jessica", "us", "female", "D"), ("af_river", "us", "female", "D"), ("am_michael", "us", "male", "C+"),
    ("am_fenrir", "us", "male", "C+"), ("am_puck", "us", "male", "C+"), ("am_echo", "us", "male", "D"), ("am_eric", "us", "male", "D"),
    ("am_liam", "us", "male", "D"), ("am_onyx", "us", "male", "D"), ("am_santa", "us", "male", "D-"), ("am_adam", "us", "male", "F+"),
    ("bf_emma", "uk", "female", "B-"), ("bf_isabella", "uk", "female", "C"), ("bf_alice", "uk", "female", "D"), ("bf_lily", "uk", "female", "D"),
    ("bm_fable", "uk", "male", "C"), ("bm_george", "uk", "male", "C"), ("bm_lewis", "uk", "male", "D+"), ("bm_daniel", "uk", "male", "D"),
]

# Tunables.
LIST_ITEM, HEADING_AFTER, PARAGRAPH, HEADING_BEFORE, SECTION = 300, 400, 500, 900, 1200
WORDS_PER_MINUTE = 150
MAX_CHARS = 2000
