"""Word lists, patterns and codes whose results must be these."""

# Fixed values. Months by language, in order.
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTHS_ID = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"]
MONTHS_FR = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
MONTHS_FR_PLAIN = ["fevrier", "aout", "decembre"]
MONTHS_ID_SHORT = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"]
MONTHS_EN_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

MONTH_NUMBER = {m.lower(): i + 1 for months in (MONTHS_EN, MONTHS_ID, MONTHS_FR) for i, m in enumerate(months)} | {"fevrier": 2, "aout": 8, "decembre": 12}
ANY_MONTH = "|".join(dict.fromkeys([*MONTHS_EN, *MONTHS_ID, *MONTHS_FR, *MONTHS_FR_PLAIN]))

# Fixed values. Calling codes in use, with runs of them written as low-high (a
# list of over 200 entries is built from this rule); the shorter is tried first.
_CODES = """1 7 20 27 30-34 36 39-41 43-49 51-58 60-66 81 82 84 86 90-95 98
211-213 216 218 220-258 260-269 290 291 297-299 350-359 370-378 380-383 385-387 389
420 421 423 500-509 590-599 670 672-683 685-692 800 808 850 852 853 855 856 870 878
880-883 886 888 960-968 970-977 979 992-996 998"""


def calling_codes() -> list[str]:
    out = []
    for part in _CODES.split():
        low, _, high = part.partition("-")
        out += map(str, range(int(low), int(high or low) + 1))
    return out


_ID, _ID3 = "(?:" + "|".join(MONTHS_ID) + ")", "(?:" + "|".join(MONTHS_ID_SHORT) + ")"
_EN, _EN3 = "(?:" + "|".join(MONTHS_EN) + ")", "(?:" + "|".join(MONTHS_EN_SHORT) + ")"
# Fixed values. English months in short, where Sept counts too.
_EN3T = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep(?:t)?|Oct|Nov|Dec)"
_TO = "(?:to|–|-)"

#: The first of the third-layer patterns (one fixed value: name, at, domain
#: with a dot), begun only where a name begins or a match has just ended, so
#: that a long run of letters isn't tried from each of them.
EMAIL_LIKE = r"(?:\G|(?<![a-zA-Z0-9_.+-]))[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"

# Fixed values. Third-layer patterns in order; all ignore case.
PATTERNS = [
    (EMAIL_LIKE, "EMAIL"),
    (r"https?://\S+|www\.\S+", "URL"),
    (r"(?<!\w)@[A-Za-z0-9_](?:[A-Za-z0-9_.-]{1,29})\b", "SOCMED_ACCOUNT"),
    (r"(?<!\w)#[A-Za-z0-9_]{1,50}\b", "KEYWORD"),
    (r'"[^"\r\n]{1,200}"', "KEYWORD"),
    (rf"\b{_ID}\s+\d{{4}}\b", "DATE"),
    (rf"\b{_ID3}\s+\d{{4}}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_ID}\s+\d{{4}}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_ID3}\s+\d{{4}}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_ID}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_ID3}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_EN}\s+\d{{4}}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_EN3}[a-z]*\s+\d{{4}}\b", "DATE"),
    (rf"{_EN}\s+\d{{4}}\s+{_TO}\s+{_EN}\s+\d{{4}}", "DATE"),
    (rf"{_EN3}\s+\d{{4}}\s+{_TO}\s+{_EN3}\s+\d{{4}}", "DATE"),
    (rf"from\s+\d{{4}}\s+{_TO}\s+\d{{4}}", "DATE"),
    (rf"\b\d{{1,2}}\s+{_EN}\b", "DATE"),
    (rf"\b\d{{1,2}}\s+{_EN3T}\b", "DATE"),
    (rf"\b{_EN}\s+\d{{1,2}}\b", "DATE"),
    (rf"\b{_EN3T}\s+\d{{1,2}}\b", "DATE"),
    (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "DATE"),
    (r"\b(?:Ibu|Bapak|Pak|Bu)\s+[A-Z][a-zA-Z]+\b", "PERSON"),
    (r"\bPT\.?\s+(?:[A-Z][A-Za-z0-9&\.\-/()]*\s+){1,8}(?:\(Persero\)\s+)?Tbk\.?", "ORG"),
    (r"\b\d{16}\b", "NIK"),
    (r"\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}", "NPWP"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_ADDRESS"),
    (r"\b(?:Jl\.|Jalan)\s\S+", "ADDRESS"),
    (r"(?:\+62|62|0)\s?(?:\(?\d{2,4}\)?[\s-]?){2,6}\d{2,4}", "PHONE_NUMBER"),
]
#: An addition: an English month and year alone is a date too.
EXTRA_PATTERNS = [(rf"\b{_EN}\s+\d{{4}}\b", "DATE")]

_STEM = "(?:" + "|".join(dict.fromkeys([*MONTHS_ID_SHORT, *MONTHS_EN_SHORT])) + ")"

# Fixed values. A text without any of these can't hold the category.
NEEDED = {"DATE": rf"(?iuU)\d\s+{_STEM}|{_STEM}[a-z]*\s+\d|from\s+\d|\d[/-]\d", "EMAIL": "@", "SOCMED_ACCOUNT": "@", "URL": "(?i)https?://|www\\.", "NIK": "[0-9]{16}", "NPWP": "[0-9]\\.[0-9]{3}\\.", "IP_ADDRESS": "[0-9]\\.[0-9]", "ADDRESS": "(?i)jl\\.|jalan", "ORG": "(?i)tbk", "PHONE_NUMBER": "[0-9]"}

# Fixed values. Titles (pattern, written form) in order, and phrases that are none.
TITLES = [
    (r"ibu", "Ibu"), (r"bapak", "Bapak"), (r"tuan", "Tuan"), (r"nyonya", "Nyonya"), (r"saudara", "Saudara"), (r"saudari", "Saudari"),
    (r"mr\.?", "Mr."), (r"mrs\.?", "Mrs."), (r"ms\.?", "Ms."), (r"miss\.?", "Miss"), (r"dr\.?", "Dr."), (r"prof\.?", "Prof."),
    (r"m\.?", "M."), (r"mme\.?", "Mme"), (r"mlle\.?", "Mlle"), (r"pr\.?", "Pr."),
]
TITLE_EXCEPTIONS = {
    "tuan": ["rumah", "tanah", "putri"],
    "ibu": ["kota", "jari", "hamil", "menyusui", "pertiwi"],
    "bapak": ["kos", "angkat", "tiri", "bangsa", "pembangunan", "reformasi", "proklamator", "negara"],
    "saudara": ["kandung", "tiri", "sepupu", "ipar", "seiman", "sebangsa", "serumah"],
}

# Fixed values. Subject continuity.
SUBJECT_TITLES = ["Ibu", "Bapak"]
SUBJECT_VERBS = ["menyatakan", "menjelaskan", "mengatakan", "menambahkan", "menerangkan", "menuturkan", "tidak", "membantu", "bertemu", "menemui", "melihat", "mengonfirmasi", "mengkonfirmasi", "menginformasikan"]
NAME_STOPWORDS = ["Percobaan", "Trial", "Based", "Kemudian", "Selanjutnya", "Pada", "Dan", "Yang", "Indonesia", "Jakarta", "Subjek"]

# Fixed values. Range connectors.
RANGE_FROM = r"(?:from|dari|sejak|depuis)"
RANGE_TO = r"(?:until|to|sampai|hingga|sd\.?|s\.d\.?|au|à|jusqu['’]?\s*à|jusqu['’]?a)"

# Fixed values. Lines and brackets whose digits are no phone numbers, by tenant.
TH_CARD_LINE = r"(?im)^[^\S\r\n]*+ID\s*+Card\s*+Number\s*+:\s*+\d[\d\s\-]{8,}\d\s*$"
TH_DATE_LINE = r"(?im)^[^\S\r\n]*+(?:Date\s++of\s++Birth|ID\s++Issued\s++Date|ID\s++Expired\s++Date)\s*+:.*$"
TH_YEAR_PAIR = r"\b\d{4}\s*+\(\s*+\d{4}\s*+\)"
TH_ADDRESS_LINE = r"(?im)^[^\S\r\n]*+Registered\s++Address\s*+:.*$"
MY_CARD = r"(?i)Identity\s*+Card\s*+number\s*+\([^)]{6,40}\)"

# Fixed values. Front door.
LOCALES, TENANTS, FORMATS = ["en", "id", "ms"], ["indonesia", "malaysia", "thailand"], ["plain", "html", "markdown"]
REGION = {"id": "ID", "ms": "MY", "en": "US"}
REGION_CODE = {"ID": "62", "MY": "60", "US": "1", "TH": "66"}
LOCALE_LANGS = {"id": ["id"], "ms": ["ms"], "en": ["en"]}
