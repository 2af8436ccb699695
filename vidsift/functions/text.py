"""Text functions. The normalisers differ on purpose; each says what it keeps.

Those that need Unicode decomposition or full case folding are Arrow UDFs; all others are column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marker words, aliases and patterns whose matches define results.
TEXT_MARKERS = (
    "chữ", "text", "biển hiệu", "biển báo", "logo", "phụ đề", "ghi", "hiển thị", "bảng", "ký tự", "con số", "số mấy",
    "địa chỉ", "đường nào", "màn hình", "đếm ngược", "written", "sign", "caption", "countdown",
)
COLOR_ALIASES = {
    "red": ("red", "đỏ", "do"),
    "blue": ("blue", "xanh duong", "xanh dương"),
    "green": ("green", "xanh la", "xanh lá"),
    "yellow": ("yellow", "vang", "vàng"),
    "white": ("white", "trang", "trắng"),
    "black": ("black", "den", "đen"),
    "orange": ("orange", "cam"),
    "pink": ("pink", "hong", "hồng"),
    "purple": ("purple", "tim", "tím"),
    "brown": ("brown", "nau", "nâu"),
}
OBJECT_ALIASES = {
    "phone": ("mobile phone", "telephone", "phone", "cell phone", "ien thoai", "dien thoai"),
    "car": ("car", "automobile", "o to", "xe hoi"),
    "vehicle": ("vehicle", "land vehicle", "xe"),
    "motorcycle": ("motorcycle", "motorbike", "xe may"),
    "screen": ("computer monitor", "television", "tv", "screen", "man hinh"),
    "hand": ("human hand", "human arm", "hand", "ban tay"),
    "person": ("person", "man", "woman", "boy", "girl", "nguoi"),
}
NUMBER_WORDS = {"một": "1", "hai": "2", "ba": "3", "bốn": "4", "năm": "5", "sáu": "6", "bảy": "7", "tám": "8", "chín": "9", "mười": "10",
                "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
COLOR_WORDS = {"đỏ": ("red",), "red": ("đỏ",), "xanh": ("blue", "green"), "blue": ("xanh",), "green": ("xanh",), "trắng": ("white",), "white": ("trắng",),
               "đen": ("black",), "black": ("đen",), "vàng": ("yellow",), "yellow": ("vàng",), "hồng": ("pink",), "pink": ("hồng",)}
UNITS = ("kg", "g", "km", "m", "cm", "phút", "giây", "hours", "minutes", "seconds")
VIDEO_ID_PATTERN = r"^L\d{2}_V\d{3}$"
DATE_PATTERNS = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "yyyyMMdd", "ddMMyyyy")
SEARCH_TOKEN = r"[\p{L}\p{N}]+"
#: Where a question begins, and where a moment of a narrative ends.
QUESTION_CLAUSE = r"(?iU)(?:[.!?]\s*)?(?:hỏi|hãy cho biết|cho biết|question)\s*[:：]?\s*"
EVENT_END = r"(?iU)(?:[.!?;]+\s*|\b(?:sau đó|tiếp theo|cuối cùng|rồi|then|after that|finally)\b)"
QUOTED = '["“”]([^"“”]+)["“”]'
SAID_DATE, WRITTEN_DATE = r"\bngay\s+(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})\b", r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
SYNONYMS = ((r"\bman\b", "person"), (r"\bwoman\b", "person"), (r"\bholding\b", "carrying"), (r"\bholds\b", "carries"), (r"\benters\b", "walks into"), (r"\bcelebrating\b", "cheering"))
ARTICLES = r"\b(?:a|an|the)\b"
MOJIBAKE_MARKERS = ("Ãâ", "Ãá", "Ãà", "Ãé", "Ãê", "Ãô", "Æ°", "Ä\x91", "Ä\x90", "á»", "áº", "â€", "â\x96", "â\x9c", "Â©", "Â®")
#: Letters of Vietnamese beyond ASCII, in lower case.
VIETNAMESE_LETTERS = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"


def _vectorised(f, kind: T.DataType = T.StringType()):
    """An Arrow UDF that applies f to each value; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _no_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def _words(s: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in s).split())


nfc = _vectorised(lambda s: unicodedata.normalize("NFC", s))
#: Case folded, letters and digits only, single spaces; accents kept.
normalize_exact = _vectorised(lambda s: _words(unicodedata.normalize("NFC", s).casefold()))
#: The same without accents, đ as d.
fold_exact = _vectorised(lambda s: _words(_no_marks(s.casefold()).replace("đ", "d")))
#: For metadata search: lower case without accents, punctuation kept.
search_fold = _vectorised(lambda s: searchable(s))
#: Object labels: compatibility decomposition, then a-z and 0-9 only, so đ drops out.
label_fold = _vectorised(lambda s: re.sub(r"[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()).strip())
#: Event decomposition: case folded without accents, đ kept.
event_fold = _vectorised(lambda s: " ".join(_no_marks(s.casefold()).split()))
#: Queries of the planners: composed, case folded, single spaces.
planner_normalize = _vectorised(lambda s: " ".join(unicodedata.normalize("NFC", s).casefold().split()))
#: Answers: composed, single spaces, case folded, without punctuation at the ends.
answer_canonical = _vectorised(lambda s: " ".join(unicodedata.normalize("NFC", s).split()).casefold().strip(" .,:;!?…"))
accent_fold = _vectorised(lambda s: _no_marks(s).replace("đ", "d"))


def spelled(s: str) -> str:
    """Metadata as it is compared word for word: composed, single blanks, at most one empty line, lower case."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", s))).strip().lower()


def searchable(s: str) -> str:
    """The same without accents, đ as d; punctuation stays."""
    return unicodedata.normalize("NFC", _no_marks(spelled(s).replace("đ", "d")))


@lru_cache(maxsize=1)
def _marked() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and that letter."""
    pairs = [(c, _no_marks(c)) for c in map(chr, range(0x80, 0x10000)) if unicodedata.decomposition(c)[:1] not in ("", "<")]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unmarked(c: Column) -> Column:
    """The text without accents, đ kept, as a column expression: what an index keeps that drops diacritics."""
    return F.regexp_replace(F.translate(c, *_marked()), r"\p{Mn}+", "")


def normalize(c: Column) -> Column:
    """normalize_exact for composed texts, as a column expression."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({SEARCH_TOKEN})"), F.lit(1))


def scoring_tokens(c: Column) -> Column:
    """Distinct tokens of two characters or more."""
    return F.filter(F.array_distinct(tokens(c)), lambda t: F.length(t) >= 2)


def metadata_text(c: Column) -> Column:
    """Single blanks, at most one empty line, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _standing(phrases: tuple[str, ...]) -> str:
    return r"(?U)(?<!\w)(?:" + "|".join(map(re.escape, phrases)) + r")(?!\w)"


def contains_phrase(text: Column, *phrases: str) -> Column:
    """One of the phrases stands between characters that aren't word characters."""
    return text.rlike(_standing(phrases))


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """Those of the phrases that the text contains, in the order of the list."""
    return F.array_compact(F.array(*[F.when(contains_phrase(text, p), F.lit(p)) for p in phrases]))


def without_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """The text with each phrase taken out, one after another, single spaces."""
    for p in phrases:
        text = F.regexp_replace(text, _standing((p,)), " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quoted_phrases(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")


def date_tokens(raw: Column, folded: Column) -> Column:
    """Dates as DDMMYYYY: `ngay D thang M nam Y` in the folded text, `D.M.Y`, `D/M/Y` or `D-M-Y` in the raw one."""
    pick = lambda c, p: F.arrays_zip(*[F.regexp_extract_all(c, F.lit(p), F.lit(i)).alias(f"p{i}") for i in (1, 2, 3)])
    both = F.concat(pick(folded, SAID_DATE), pick(raw, WRITTEN_DATE))
    return F.array_distinct(F.transform(both, lambda d: F.concat(F.lpad(d["p1"], 2, "0"), F.lpad(d["p2"], 2, "0"), d["p3"])))


def parse_date(c: Column) -> Column:
    """The first of the five formats that fits; null if none does."""
    t = F.trim(c)
    eight = t.rlike(r"^\d{8}$")
    tries = [F.when(eight if p in ("yyyyMMdd", "ddMMyyyy") else ~eight, F.try_to_date(t, p)) for p in DATE_PATTERNS]
    return F.coalesce(*tries)


def question_scene(c: Column) -> Column:
    """What stands before the first question clause; the whole text if nothing does."""
    scene = F.element_at(F.split(F.trim(c), QUESTION_CLAUSE, 2), 1)
    scene = F.btrim(scene, F.lit(" ,.;:-"))
    return F.when(scene != "", scene).otherwise(F.trim(c))


def split_events(c: Column, most: int = 5) -> Column:
    """Moments of a narrative: split at sentence ends and connectors, 8 characters or more, each once, `most` at most; the whole
    text, with single spaces, where none is left."""
    clean = F.transform(F.split(c, EVENT_END), lambda p: F.trim(F.regexp_replace(F.btrim(p, F.lit(" ,.;:-")), r"(?U)\s+", " ")))
    long = F.slice(F.array_distinct(F.filter(clean, lambda p: F.length(p) >= 8)), 1, most)
    return F.when(F.size(long) > 0, long).otherwise(F.array(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))))


def query_variants(c: Column, most: int = 3) -> Column:
    """Substitutions of common words and the text without articles, those that differ from it."""
    made = [F.regexp_replace(c, "(?iU)" + p, r) for p, r in SYNONYMS]
    made.append(F.trim(F.regexp_replace(F.regexp_replace(c, "(?iU)" + ARTICLES, " "), r"(?U)\s+", " ")))
    return F.slice(F.array_distinct(F.filter(F.array(*made), lambda v: (v != c) & (v != ""))), 1, most)


def has_mojibake(c: Column) -> Column:
    """One of the sequences that Vietnamese letters and signs become when UTF-8 is read as Latin; a quick test for reports."""
    return F.exists(F.array(*[F.lit(m) for m in MOJIBAKE_MARKERS]), lambda m: F.contains(c, m))


def has_vietnamese(c: Column) -> Column:
    return F.lower(c).rlike(f"[{VIETNAMESE_LETTERS}]")


def log_confidence(mean_log_probability: Column) -> Column:
    """A recogniser's mean log probability as a confidence from 0 to 1; null stays null."""
    return F.when(mean_log_probability.isNotNull(), F.least(F.greatest(F.exp(mean_log_probability), F.lit(0.0)), F.lit(1.0)))


def picked_confidence(*candidates: Column) -> Column:
    """The first stated confidence (score, recogniser, detector), clipped to 0..1; 1 where none is stated."""
    return F.least(F.greatest(F.coalesce(*candidates, F.lit(1.0)).cast("double"), F.lit(0.0)), F.lit(1.0))


def has_control_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"[\n\r\t]", "").rlike(r"\p{Cc}")


def color_of(c: Column) -> Column:
    """The first colour one of whose aliases is a part of the text, anywhere (so `door` has red's `do`)."""
    low = F.lower(c)
    hit = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n))
    return F.coalesce(*[F.when(hit(names), F.lit(color)) for color, names in COLOR_ALIASES.items()])


def object_alias(folded: Column) -> Column:
    """The common name of a folded label; without one, the label with underscores."""
    names = [x for k, v in OBJECT_ALIASES.items() for a in v for x in (F.lit(a), F.lit(k))]
    return F.coalesce(F.create_map(*names)[folded], F.regexp_replace(folded, " +", "_"))


def answer_alternatives(canonical: Column) -> Column:
    """Other accepted spellings of a canonical answer: without accents, number words, colours, units with and without a blank."""
    number = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])[canonical]
    color = F.create_map(*[x for k, v in COLOR_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])[canonical]
    unit = "|".join(sorted(UNITS, key=len, reverse=True))
    spaced = F.when(canonical.rlike(rf"^\d+(?:[.,]\d+)?\s+(?:{unit})$"), F.regexp_replace(canonical, r"\s+", ""))
    tight = F.when(canonical.rlike(rf"^\d+(?:[.,]\d+)?(?:{unit})$"), F.regexp_replace(canonical, rf"^(\d+(?:[.,]\d+)?)({unit})$", "$1 $2"))
    listed = F.concat(F.array(accent_fold(canonical), number), F.coalesce(color, F.array().cast("array<string>")), F.array(spaced, tight))
    return F.array_except(F.array_distinct(F.array_compact(listed)), F.array(canonical))


def preview(c: Column, length: int = 240) -> Column:
    return F.substring(c, 1, length)
