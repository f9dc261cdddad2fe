"""Pages, lines and running lines of texts of scanned pages."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field
from difflib import SequenceMatcher

PAGE_END = re.compile(r"\[!@#\$%\]EOP(\d+)\[!@#\$%\]")
# --- fixed values: how lines with a page number only, and codes of documents, look -----------------
NUMBER_LINE = re.compile(r"(?i)[\[(\-–—]?\s*(?:(?:page|seite|стр\.?|стор\.?|стp\.?|pag\.?|p\.|s\.|с\.)\s*)?\d{1,4}(?:\s*(?:/|of|из|von|з|de)\s*\d{1,4})?\s*[\])\-–—]?")
CODE = re.compile(r"[A-Z]{1,2}\d[\d.']{1,6}\d")
SMALL = {"issue", "p", "rev", "doc", "oc", "of"}
# ---------------------------------------------------------------------------------------------------
TORN_MARKS = "-¬~=‐"


@dataclass
class Page:
    number: int
    start: int
    body: str
    lines: list[str] = field(default_factory=list)
    running: set[int] = field(default_factory=set)


def split_pages(text: str) -> list[Page]:
    """Pages by their end marks; what stands behind the last mark is a page of its own if it isn't blank."""
    out, at = [], 0
    for m in PAGE_END.finditer(text):
        out.append(Page(int(m[1]), at, text[at : m.start()]))
        at = m.end()
    if text[at:].strip():
        out.append(Page(out[-1].number + 1 if out else 0, at, text[at:]))
    return out


def heads_of(headers: str | None) -> list[tuple[int, str]]:
    """[(position, text)] of the JSON headers; anything unreadable gives none."""
    try:
        return [(int(p), str(t)) for p, t in json.loads(headers or "[]")]
    except (ValueError, TypeError):
        return []


def _coded(line: str) -> bool:
    """A short line of a document's code, a company and counters only."""
    if len(line) > 50 or not CODE.search(line) or line.endswith((".", ",", ";", ":")) and not re.search(r"p\. ?\d*\.?$", line):
        return False
    words = re.findall(r"[^\W\d_]+", CODE.sub(" ", line))
    return len(words) <= 5 and all(w[0].isupper() or w.lower() in SMALL or len(w) == 1 for w in words)


def _shouted(line: str) -> bool:
    """A short line of capitals without digits."""
    letters = re.sub(r"[\W\d_]+", "", line)
    return 3 < len(letters) <= 26 and letters.isupper() and not re.search(r"\d", line) and len(letters) >= 0.7 * len(line.replace(" ", ""))


@functools.lru_cache(50_000)
def _alike(a: str, b: str) -> bool:
    """True for lines whose ratio is 0.8 or more; the bounds that are quickly found go first."""
    if 2 * min(len(a), len(b)) < 0.8 * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= 0.8 and m.ratio() >= 0.8


def mark_running(pages: list[Page], heads: list[tuple[int, str]]) -> None:
    """Fill lines and running of each page: the first and last line of a page where it is a running header, footer or page number.

    Such a line is a bare page number, a short line of code and company, a short line of capitals, or nearly the
    same (but for its numbers) as another page's line in that place which is one; headings, which are given, are none.
    """
    starts = {p for p, _ in heads}
    seats: dict[str, list[tuple[Page, int, str]]] = {"top": [], "foot": []}
    for p in pages:
        p.lines, p.running = p.body.split("\n"), set()
        filled = [i for i, line in enumerate(p.lines) if line.strip()]
        if not filled:
            continue
        at = p.start
        offsets = []
        for line in p.lines:
            offsets.append(at)
            at += len(line) + 1
        for seat, i in (("top", filled[0]), ("foot", filled[-1])):
            if offsets[i] not in starts and (seat == "top" or len(filled) > 1):
                seats[seat].append((p, i, p.lines[i].strip()))
    for rows in seats.values():
        sure = [(p, i, t) for p, i, t in rows if NUMBER_LINE.fullmatch(t) or _coded(t) or _shouted(t)]
        for p, i, _ in sure:
            p.running.add(i)
        known = {re.sub(r"\d+", "9", t) for _, _, t in sure}
        for p, i, t in rows:
            if i not in p.running and len(t) <= 50 and any(_alike(re.sub(r"\d+", "9", t), k) for k in known if len(k) > 4):
                p.running.add(i)


def read(text: str | None, headers: str | None) -> list[Page]:
    """The pages of a file with their running lines marked."""
    pages = split_pages(text or "")
    mark_running(pages, heads_of(headers))
    return pages
