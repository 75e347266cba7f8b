"""File names of scanned books: titles, authors, volume, edition and year, by the habits of their sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.functions.keys import BENGALI_DIGITS, DIGITS, NO_PERSONS, SERIES

_D = f"[{BENGALI_DIGITS}{DIGITS}]"
_ASCII = str.maketrans(BENGALI_DIGITS, DIGITS)
ENDS = " \t -_–—:;,."
#: What download sites add to names, parts of books, and words before an author.
BOILERPLATE = ("বাংলা বই পিডিএফ ডাউনলোড", "Bengali Book PDF Download", "Bangla Book Pdf", "Bangla PDF", "pdf download")
WAITING = "is waiting to be download!!!"
FRAGMENTS = ("preliminary page", "title page", "appendix", "index", "contents", "cover")
ROLES = ("লিখেছেন", "সম্পাদিত", "সম্পাদনা", "অনূদিত", "অনুবাদ", "রচিত", "রচনা")
LINK_LISTS = ("১০০+", "100+", "বইয়ের ডাউনলোড লিঙ্ক", "বইয়ের pdf ডাউনলোড লিঙ্ক")
#: The habit of each source. ``nothing``: names are placeholders.
HABITS = {"granthagara": "two titles", "bengaliebook": "two languages", "amarbooks": "marked author", "rarebooksociety": "author first", "amarboi": "author first", "allbanglaboi": "by", "banglabook": "title", "books": "title", "pdfporo": "title", "authordir": "title first", "banglabooks_in": "nothing", "banglabookshelf": "nothing"}
#: What a name states, in the order in which it is looked for and taken out.
EDITION = (rf"\[\s*সংস্করণ\s*[-–—: ]*\s*({_D}+)\s*\]", rf"(?i)\[\s*Eds?\.?\s*({_D}+)\s*\]")
VOLUME = (rf"\[\s*ভাগ\s*[-–—: ]*\s*({_D}+)\s*\]", rf"(?i)\[\s*Pts?\.?\s*({_D}+)\s*\]")
YEAR = (rf"\[\s*({_D}{{4}})\s*\]\s*$",)
LOOSE_VOLUME = (rf"পর্ব\s*({_D}+)", rf"\(\s*({_D}+)\s*\)\s*$", rf"^\s*\(\s*({_D}+)\s*\)\s*", rf"^\s*({_D}+)\s*[।.]\s*")
FIELDS = T.StructType().add("titles", T.ArrayType(T.StringType())).add("authors", T.ArrayType(T.StringType())).add("source", T.StringType()).add("volume", T.StringType()).add("edition", T.StringType()).add("year", T.StringType()).add("is_not_a_book", T.BooleanType()).add("confidence", T.DoubleType()).add("directory_author", T.StringType())


def tidy(text: str) -> str:
    return " ".join(text.split())


def part(text: str) -> str:
    return tidy(text).strip(ENDS)


def person(value: str) -> bool:
    """Whether a name may be a person's: by its form, not by a list of people."""
    name = tidy(value)
    low = name.casefold()
    if len(name) < 2 or low in NO_PERSONS or any(m in low for m in SERIES) or " - " in name or "_" in name:
        return False
    return " " in name or bool(re.search("[ঀ-৿]", name))


def bare(stem: str) -> str:
    """A name without what sites add."""
    text = re.sub(r"\s+-\s+[0-9a-fA-F]{12}\s*$", "", stem)
    text = re.sub(re.escape(WAITING), " ", text, flags=re.IGNORECASE)
    text = re.sub(r"(?i)^\s*unknown author\s*-\s*", "", text)
    return part(re.sub("|".join(map(re.escape, BOILERPLATE)), " ", text, flags=re.IGNORECASE))


def no_book(name: str) -> bool:
    low = name.strip().lower()
    return bool(low) and (low in FRAGMENTS or bool(re.match(rf"chapter[\s_\d\-p{BENGALI_DIGITS}]*$", low)) or bool(re.search(rf"{_D}+\s*টি.*লিঙ্ক", name)) or any(x in low for x in LINK_LISTS))


def numbers(text: str) -> tuple[str, str | None, str | None, str | None]:
    """(rest, volume, edition, year): each is the first of its patterns that is there; a year lies in 1800 to 2030."""

    def first(patterns, good=lambda n: True):
        nonlocal text
        for p in patterns:
            if (m := re.search(p, text)) and good(n := m[1].translate(_ASCII)):
                text = tidy(f"{text[:m.start()]} {text[m.end():]}")
                return n
        return None

    edition, volume = first(EDITION), first(VOLUME)
    year = first(YEAR, lambda n: 1800 <= int(n) <= 2030)
    volume = volume or first(LOOSE_VOLUME)
    return part(text), volume, edition, year


def at_role(title: str) -> tuple[str, str] | None:
    """(title, person) around the last word that names a role and stands alone."""
    edge = r"[\s\-_–—:;,.()\[\]\"'“”‘’/]"
    found = None
    for m in re.finditer(rf"(?:(?<={edge})|^)({'|'.join(ROLES)})(?={edge}|$)", title):
        if (a := part(title[:m.start()])) and (b := part(title[m.end():])):
            found = a, b
    return found


def divided(habit: str, work: str, marked: bool) -> tuple[list[str], list[str], float]:
    """(titles, authors, confidence) of a name by its source's habit; the whole name is a weak title where it does not fit."""
    weak = [work], [], 0.2
    dashed = [p for p in map(part, work.split(" - ")) if p]
    if habit == "two titles":
        return ([p for p in map(part, work.split("_")) if p], [], 0.8) if "_" in work else weak
    if habit == "two languages" and (m := re.search(r"\(([^()]*)\)\s*$", work)):
        left, right = part(work[:m.start()]), re.split(r"(?i)\s+by\s+", m[1].strip(), maxsplit=1)
        title, _, author = left.rpartition("-") if "-" in left else (left, "", "")
        pick = lambda names: [p for p in map(part, names) if p]
        return pick([title, right[0]]), pick([author, *right[1:]]), 1.0 if len(right) == 2 else 0.8
    if habit == "marked author" and marked:
        head, _, tail = work.partition(" - ")
        return ([part(tail)], [part(head)], 1.0) if part(tail) and part(head) else ([work], [], 1.0)
    if habit == "author first" and " - " in work:
        head, _, tail = work.partition(" - ")
        return [part(tail)] if part(tail) else [], [part(head)] if part(head) else [], 0.8
    if habit == "by":
        if m := re.search(r"(?i)\s+by\s+", work):
            after = [p for p in map(part, work[m.end():].split(" - ")) if p]
            before = [p for p in [part(work[:m.start()])] if p]
            return (before + after[1:], after[:1], 1.0) if after else (before, [], 0.2)
        return dashed, [], 0.2
    if habit == "title first" and " - " in work:
        head, _, tail = work.rpartition(" - ")
        return [part(head)] if part(head) else [], [part(tail)] if part(tail) else [], 0.5
    return weak


def parse_path(path: str) -> tuple:
    """The fields of FIELDS for a path: a source's folder below ``incoming-scraped`` tells the habit, other paths have the title
    first and the author's folder around them."""
    steps = re.split(r"[\\/]", path or "")
    at = steps.index("incoming-scraped") + 1 if "incoming-scraped" in steps[:-1] else len(steps)
    source = steps[at] if at < len(steps) and steps[at] else "authordir"
    stem = re.sub(r"(?<=.)\.[^.]*$", "", steps[-1]).strip()
    if source == "banglabook":
        try:
            stem = stem.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    work, habit = bare(stem), HABITS.get(source, "title")
    if no_book(work):
        return [], [], source, None, None, None, True, 1.0, None
    if habit == "nothing":
        return [], [], source, None, None, None, False, 0.0, None
    work, volume, edition, year = numbers(work)
    if not work:
        return [], [], source, volume, edition, year, False, 0.0, None
    titles, authors, confidence = divided(habit, work, WAITING.lower() in stem.lower())
    roles = [at_role(t) for t in titles]
    if any(roles):
        titles, authors, confidence = [r[0] if r else t for t, r in zip(titles, roles)], [*(r[1] for r in roles if r), *authors], 1.0
    folder = part(steps[-2]) if source == "authordir" and len(steps) > 1 else ""
    folder = folder if folder and person(folder) else None
    titles, authors = list(dict.fromkeys(titles)), list(dict.fromkeys([*authors, *([folder] if folder else [])]))
    return titles, authors, source, volume, edition, year, False, confidence if titles or authors else 0.0, folder


def parse_title(value: str) -> tuple:
    """The same fields for a title inside a file that is really a file name: what stands behind `` by ``, a danda, a dash or in
    brackets at the end is the author, if it may be a person."""
    raw = re.sub(r"(?i)\.(?:pdf|epub|mobi|azw3?|djvu|txt)\s*$", "", value or "")
    work = bare(re.sub(r"(?i)[\(\[]\s*[\w-]+\.(?:com|net|org|info|io|co)\s*[\)\]]", " ", raw))
    work, volume, edition, year = numbers(work)
    title, author = work, ""
    for pattern in (r"(?i)^(.*?\S)\s+by\s+(\S.*)$", r"^(.*\S)\s*(?:।।|॥|।\s*।)\s*(\S.*)$", r"^(.*\S)\s[-–—]\s(.*)$", r"^(.*?)\s*\(([^()]{4,})\)\s*$"):
        if m := re.match(pattern, work):
            title, author = part(m[1]), part(m[2])
            break
    if author and not person(author):
        title, author = work, ""
    return [title] if title else [], [author] if author else [], "embedded_title", volume, edition, year, False, (0.7 if author else 0.4) if title else 0.0, None


def _fields(parse):
    @pandas_udf(FIELDS)
    def parsed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) for v in values], columns=FIELDS.names)

    return parsed


parsed_path, parsed_title = _fields(parse_path), _fields(parse_title)
