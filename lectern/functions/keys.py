"""Keys of titles and names, volumes, identifiers and file names, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.functions.text import collapsed, nfc

#: Characters without width, Bengali digits, and their block.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad\u202a\u202b\u202c\u202d\u202e"
BENGALI_DIGITS, DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"
BLOCK = "\u0980-\u09ff"
#: Letters that scans confuse, and what stands for them; vowel signs that are dropped.
CONFUSED, STANDS_FOR = "ভরণশষয", "ববনসসজ"
VOWEL_SIGNS = "[\u09be-\u09cc\u09d7]"
#: Honorifics before a name, and inside a Bengali title.
HONORIFICS = ("শ্রী", "শ্রীমতী", "ড.", "ডঃ", "ডাঃ", "অধ্যাপক", "বিচারপতি")
ENGLISH_HONORIFICS = ("dr", "prof", "professor", "sri", "shri")
TITLE_HONORIFICS = ("শ্রী", "মহোদয়", "বাবু", "দা.", "দাদা", "দিদা", "খান", "সাহেb", "মহাশয়")
#: Words beside which a number is a volume, and ordinals.
VOLUME_WORDS = "(?:খণ্ড|পর্ব|ভাগ|সংস্করণ|part|vol|volume|khanda|parba)"
ORDINALS = ("প্রথম", "দ্বিতীয়", "তৃতীয়", "চতুর্থ", "পঞ্চম", "ষষ্ঠ", "সপ্তম", "অষ্টম", "নবম", "দশম", "একাদশ", "দ্বাদশ", "ত্রয়োদশ", "চতুর্দশ", "পঞ্চদশ", "ষোড়শ", "সপ্তদশ", "অষ্টাদশ", "ঊনবিংশ", "বিংশ")
#: What is no title and no author.
NO_TITLES = ("document", "new document", "microsoft word", "word document", "print", "scan", "scanned", "scanned document", "book", "book1", "pdf", "document1", "doc1", "test", "test document", "default", "title")
NO_AUTHORS = ("unknown", "unknown author", "administrator", "admin", "user", "users", "owner", "anonymous", "none", "n/a", "na", "null", "author", "authors", "no author")
#: Folders that are no person's, and marks of series and publishers.
NO_PERSONS = ("epub-staging", "others", "বিবিধ", "উপন্যাস", "সমকালীন উপন্যাস", "গল্প", "কবিতা", "প্রবন্ধ", "ইতিহাস", "বাংলাদেশের ইতিহাস", "হিন্দু ধর্ম", "ইসলাম", "মহাভারত", "রামায়ণ", "ম্যাগাজিন", "পত্রিকা", "অনুবাদ", "সংকলন", "books", "data", "pdf", "misc", "unsorted", "new", "temp", "download", "ই-পাব", "ইপাব", "epub", "epubs", "e-pub", "ebook", "ebooks", "ই-বুক")
SERIES = ("সিরিজ", "প্রকাশনী", "রচনাবলী", "সমগ্র", "সংকলন", "কমিকস", "পত্রিকা", "series", "comics", "publications", "publishers", "collection", "magazine", "staging", "archive", "vol.", "volume")

_NO_WIDTH = {ord(c): None for c in ZERO_WIDTH} | {ord(b): d for b, d in zip(BENGALI_DIGITS, DIGITS)}
_NO_KEY = re.compile(rf"(?:[^\w{BLOCK}]|_)+")


def text_key(value: str | None) -> str:
    """NFC, without characters of no width, ASCII digits, case-folded, other than letters and digits as one space."""
    return _NO_KEY.sub(" ", unicodedata.normalize("NFC", value or "").translate(_NO_WIDTH).casefold()).strip()


@pandas_udf(T.StringType())
def normalize_text(value: pd.Series) -> pd.Series:
    """The key that titles and texts are matched by; empty for null."""
    return value.map(text_key)


@pandas_udf(T.StringType())
def casefolded(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else v.casefold())


def normalize_name(value: Column) -> Column:
    """The key of a person: without what stands in brackets at the end, ``Last, First`` turned if there is one comma, and
    without honorifics before it."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?:\s*\([^()]*\))+\s*$", "")
    first, second = F.trim(F.split_part(bare, F.lit(","), F.lit(1))), F.trim(F.split_part(bare, F.lit(","), F.lit(2)))
    turned = F.when((F.regexp_count(bare, F.lit(",")) == 1) & (first != "") & (second != ""), F.concat_ws(" ", second, first)).otherwise(bare)
    titles = "|".join([*(re.escape(h) for h in HONORIFICS), *(rf"(?i:{h})\.*" for h in ENGLISH_HONORIFICS)])
    return normalize_text(F.regexp_replace(collapsed(turned), rf"^(?:(?:{titles})(?:\s+|$))+", ""))


@pandas_udf(T.StringType())
def repair_mojibake(value: pd.Series) -> pd.Series:
    """UTF-8 that was read as Latin-1, read again; text with Bengali letters, without letters from À to ÿ, or of which the
    bytes are no UTF-8, stays. Blank and null give the empty text."""

    def repaired(v):
        if not v or not v.strip():
            return ""
        if not re.search("[\u00c0-\u00ff]", v) or re.search(f"[{BLOCK}]", v):
            return v
        try:
            return v.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return v

    return value.map(repaired)


def fold_bengali(value: Column) -> Column:
    """A lossy second key: confused letters as one, vowel signs dropped."""
    return F.regexp_replace(F.translate(normalize_text(value), CONFUSED, STANDS_FOR), VOWEL_SIGNS, "")


def normalize_bengali(value: Column) -> Column:
    """NFC without nukta and honorifics, white space collapsed."""
    inside = "|".join(map(re.escape, TITLE_HONORIFICS))
    return collapsed(F.regexp_replace(F.regexp_replace(nfc(value), "\u09bc", ""), f"(?:{inside})", ""))


def title_sort_key(title: Column) -> Column:
    return F.lower(normalize_bengali(title))


def policy_view(text: Column, policy: str) -> Column:
    """A text under a policy: ``raw``, ``nfc_strict``, or ``nfc_search`` with quotes folded and white space collapsed."""
    if policy == "raw":
        return text
    if policy == "nfc_strict":
        return nfc(text)
    if policy == "nfc_search":
        return collapsed(F.translate(nfc(text), "‘’“”", "''\"\""))
    raise ValueError(f"unknown text policy {policy!r}")


def benchmark_view(text: Column) -> Column:
    """NFC, single curly quotes folded, white space collapsed."""
    return collapsed(F.translate(nfc(text), "‘’", "''"))


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def shingle_view(text: Column) -> Column:
    """NFC, letters, digits and single spaces alone, in lower case."""
    return F.lower(collapsed(F.regexp_replace(nfc(text), r"[^\p{L}\p{N}\s]", "")))


def clean_line(text: Column) -> Column:
    """NFC, no white space before closing marks, white space collapsed."""
    return collapsed(F.regexp_replace(nfc(text), r"\s+([।,;:!?])", "$1"))


def tidy(text: Column, ends: str = " \t\u00a0-_–—:;,.") -> Column:
    """White space collapsed, no marks at the ends."""
    return F.btrim(collapsed(text), F.lit(ends))


def volume_tokens(name: Column) -> Column:
    """The volumes that a file's name states: numbers beside volume words, ordinals, and a number at the end; without zeros
    before. Folders and the extension are no part of the name."""
    file = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=[^.])\.[^.]+$", "")
    stem = F.translate(file, BENGALI_DIGITS, DIGITS)
    after = F.regexp_extract_all(stem, F.lit(rf"(?i){VOLUME_WORDS}[\s\-._:]*([0-9]{{1,3}})"), F.lit(1))
    before = F.regexp_extract_all(stem, F.lit(rf"(?i)([0-9]{{1,3}})[\s\-._:]*{VOLUME_WORDS}"), F.lit(1))
    last = F.regexp_extract_all(stem, F.lit(r"[\-_\s]([0-9]{1,3})\s*$"), F.lit(1))
    named = F.array_compact(F.array(*[F.when(stem.contains(word), F.lit(str(k))) for k, word in enumerate(ORDINALS, 1)]))
    bare = F.transform(F.concat(after, before, last, named), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))
    return F.array_sort(F.array_distinct(bare))


def volume_conflict(a: Column, b: Column) -> Column:
    """Whether two names state different volumes, or one of them alone states any."""
    return volume_tokens(a) != volume_tokens(b)


def volume_number(title: Column) -> Column:
    """The last number of one or two digits that stands alone, in either script."""
    return F.try_element_at(F.regexp_extract_all(F.translate(title, BENGALI_DIGITS, DIGITS), F.lit(r"(?<!\d)\d{1,2}(?!\d)"), F.lit(0)), F.lit(-1)).try_cast("int")


def numeric_or_uuid(text: Column) -> Column:
    bare = F.regexp_replace(text, r"[\s\-._]", "")
    return bare.rlike("^[0-9]+$") | F.trim(text).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def junk_title(title: Column, file: Column) -> Column:
    """Whether a title is blank, the file's name, a path, a placeholder, a number or a UUID."""
    low = F.lower(F.trim(title))
    stem = F.regexp_replace(F.lower(file), r"\.[^.]*$", "")
    odd = low.rlike(r"[/\\]") | low.rlike(r"\.(?:pdf|doc|docx|indd)$") | low.isin(*NO_TITLES) | low.rlike(r"^untitled[\s\-_#\d]*$") | low.startswith("microsoft word")
    return (low == "") | (low == F.lower(file)) | (low == stem) | odd | numeric_or_uuid(title)


def junk_author(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return (low == "") | low.isin(*NO_AUTHORS) | numeric_or_uuid(name)


def split_authors(value: Column) -> Column:
    """Names of an author field: parts at semicolons and ``and``, then at commas, but for a part with a single comma."""
    parts = F.filter(F.transform(F.split(value, r";|(?i:\s+and\s+)"), lambda p: F.trim(p)), lambda p: p != "")
    names = F.flatten(F.transform(parts, lambda p: F.when(F.regexp_count(p, F.lit(",")) == 1, F.array(p)).otherwise(F.split(p, ","))))
    return F.filter(F.transform(names, lambda n: collapsed(n)), lambda n: ~junk_author(n))


#: What may stand for an ISBN in running text, digits with a hyphen or space behind.
ISBN13 = re.compile(r"(?<!\d)(?:\d[\s\-\u00ad]?){13}(?!\d)")
ISBN10 = re.compile(r"(?<!\d)(?:\d[\s\-\u00ad]?){9}[\dX](?!\d)", re.IGNORECASE)


def isbn_runs(text: str) -> list[str]:
    """All runs of 13 digits, and those of 10 that touch none of these, in order of place."""
    long = [m.span() for m in ISBN13.finditer(text)]
    ends, starts = [e for _, e in long], [s for s, _ in long]
    # the first long run that ends behind a short one's start is the only one that can touch it
    short = [(s, e) for s, e in (m.span() for m in ISBN10.finditer(text)) if (k := bisect_right(ends, s)) == len(long) or starts[k] >= e]
    return [text[s:e] for s, e in sorted(long + short)]


@pandas_udf(T.ArrayType(T.StringType()))
def isbn_candidates(text: pd.Series) -> pd.Series:
    """``isbn_runs`` of each text: all runs of 13 are looked for before any of 10, which one pattern cannot say; null stays null."""
    return pd.Series([None if t is None else isbn_runs(t) for t in text], dtype=object)


def canonical_isbn10(value: Column) -> Column:
    """A valid ISBN-10 without hyphens, in upper case; null otherwise."""
    bare = F.upper(F.regexp_replace(value, "[-\\s\u00ad]", ""))
    digit = lambda i: F.when(F.substring(bare, i, 1) == "X", 10).otherwise(F.substring(bare, i, 1).try_cast("int"))
    return F.when(bare.rlike("^[0-9]{9}[0-9X]$") & (sum(((11 - i) * digit(i) for i in range(1, 11)), F.lit(0)) % 11 == 0), bare)


def person_name(value: Column) -> Column:
    """Whether a folder's name may be a person's: two characters or more, none of the known folders, no mark of a series or
    publisher, no separator, and a space or a Bengali letter."""
    name = collapsed(value)
    low = F.lower(name)
    marked = low.isin(*NO_PERSONS) | low.rlike("|".join(map(re.escape, SERIES))) | name.contains(" - ") | name.contains("_")
    return (F.char_length(name) >= 2) & ~marked & (name.contains(" ") | name.rlike(f"[{BLOCK}]"))


def path_author(path: Column) -> Column:
    """The folder that holds a file, if it is no hidden one; else empty."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    folder = F.try_element_at(parts, F.lit(-2))
    return F.when(folder.isNull() | folder.startswith("."), "").otherwise(folder)


def path_title(path: Column) -> Column:
    """A file's name without its extension and without what stands behind the last dash."""
    name = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"\s*[-–—]\s*[^-–—]+$", "")


def redacted(text: Column, secrets: list[str]) -> Column:
    """A text without secrets and the hosts of those that are addresses."""
    for s in filter(None, secrets):
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
        if host := re.match(r"https?://([^/:?#\s]+)", s):
            text = F.replace(text, F.lit(host[1]), F.lit("[redacted-host]"))
    return text


def page_indexes(pages: Column) -> Column:
    """The pages that stand for a document: the first two and those at a quarter, half and three quarters."""
    at = lambda share: F.floor(pages * share)
    return F.array_distinct(F.filter(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), at(0.25), at(0.5), at(0.75)), lambda p: p < pages))
