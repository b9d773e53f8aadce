"""Where free text names persons or how to reach them: spans of five kinds, with code-point positions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

try:
    import ahocorasick
except ImportError:  # words are looked up one by one then
    ahocorasick = None

# White space inside an entity, as typed or laid out (no line break).
_S = "[ \t   -​  　]"
_SS = _S + "{1,3}"
_S0 = _S + "{0,3}"
_DASH = "[-‐-―−]"

# Words between the parts of a name.
CONNECTORS = ("bin", "binti", "binte", "bte", "bt", "de", "da", "do", "dos", "del", "van", "al", "a/l", "a/p")
# Words after a name that make it the name of an institution, street or place.
INSTITUTION_AFTER = (
    "General", "District", "Provincial", "Regional", "Memorial", "Community", "Central", "National", "Public", "Primary",
    "Hospital", "Foundation", "Clinic", "Institute", "School", "University", "College", "Laboratory", "Laboratories", "Lab",
    "Centre", "Center", "Health", "Medical", "Maternity", "Pharmacy", "Research", "Trust", "Society", "Fund", "Award", "Prize",
    "Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Close", "Village", "Bridge", "Market", "Park", "Square", "Building",
    "Boulevard", "Drive", "Crescent", "Gate", "Estate", "Heights", "Terrace", "Hall", "Stadium", "Airport", "Station",
)
# Words before a name that make it the name of an institution, street or place.
INSTITUTION_BEFORE = (
    "Jl.", "Jl", "Jalan", "Jln", "Kp.", "Kampung", "Rua", "Avenida", "Travessa", "Lorong", "Lrg", "Taman", "đường", "Đường", "phố", "ấp", "xã", "phường",
    "ถนน", "ซอย", "โรงพยาบาล", "โรงเรียน", "มูลนิธิ", "Bệnh viện", "Trường", "Quỹ", "Viện", "Rumah Sakit", "RS", "RSUD", "RSIA", "Klinik", "Puskesmas",
    "Yayasan", "Universitas", "Fundação", "Clínica", "Escola", "Instituto", "Hospital de", "Hospital", "Ospital ng", "Paaralang", "Brgy.", "Barangay",
    "Sitio", "Street", "Foundation of", "Institute of", "Mount", "Lake", "Port", "Fort", "Klinika", "Centro de Saúde",
)
# Words before a number that is of a sample, lot, file or good, a measure or a date.
_THING = r"(?:sample|samples|batch|tube|tubes|lot|barcode|kit|reference|ref|grid|coordinates|line|budget|version|file|vial|order|invoice|serial|model|asset|crate|parcel|form|annex|code|sampel|mẫu|lô|amostra|lote|sampol)"
_OF_THING = re.compile(rf"(?:(?<!\w){_THING}|ตัวอย่าง|\d{{2}}[A-Z])(?:{_S}*(?:no\.?|number|nr\.?|#|:|n\.º|số))?{_S}*$", re.I)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


# ---- e-mail -------------------------------------------------------------------------------------------------
_AT = rf"(?:[@＠﹫]|{_SS}[@＠﹫]{_SS}|{_S0}[\[({{<]{_S0}(?:at|arroba|@){_S0}[\])}}>]{_S0})"
_DOT = rf"(?:[.．]|{_S0}[\[({{<]{_S0}(?:dot|ponto|titik|\.){_S0}[\])}}>]{_S0})"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(rf"(?<![\w.+-])[^\W_](?:[\w.+'-]|{_S0}[\[(]{_S0}dot{_S0}[\])]{_S0}(?=\w))*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|(?<![\w.+-])[^\W_][\w.+-]*{_SS}at{_SS}{_LABEL}(?:{_SS}dot{_SS}{_LABEL})+", re.I)

# ---- numbers ------------------------------------------------------------------------------------------------
_N0, _N1 = r"(?<![\w/.,+-])", r"(?![\w/-]|[.,]\d)"
IDENTITY = re.compile(
    rf"{_N0}(?:"
    rf"\d{_DASH}\d{{4}}{_DASH}\d{{5}}{_DASH}\d{{2}}{_DASH}\d"
    rf"|\d{{6}}{_DASH}\d{{2}}{_DASH}\d{{4}}"
    rf"|[A-Z]{{2}}{_DASH}\d{{4}}{_DASH}\d{{2}}{_DASH}\d{{3}}"
    rf"|\d{{4}}{_SS}\d{{4}}{_SS}\d{{4}}(?:{_SS}\d{{4}})?"
    rf"|\d{{16}}|\d{{12}}"
    rf"|[A-Za-z]{{1,2}}\d{{7}}[A-Za-z]?"
    rf"){_N1}"
)
_EXT = rf"(?:{_S0},?{_S0}(?:ext\.?|x|ramal|máy lẻ|ต่อ|loc\.?|local){_S0}\d{{1,5}})?"
PHONE = re.compile(
    rf"(?<![\w/.,+-])(?<!\w\()(?:"
    rf"(?:\+|00)\d{{1,3}}(?:{_SS}|{_DASH}|\.)?\(?\d{{1,4}}\)?(?:(?:{_SS}|{_DASH}|\.)\d{{2,7}}){{1,4}}"
    rf"|\+\d{{8,15}}|00\d{{9,14}}"
    rf"|\(0?\d{{2,3}}\){_S0}\d{{3,4}}(?:{_DASH}|{_SS}|\.)\d{{3,4}}"
    rf"|0\d{{3}}\.\d{{3}}\.\d{{3}}|0\d{{3}}{_DASH}\d{{4}}{_DASH}\d{{3}}|0\d{{2,3}}{_DASH}\d{{3,4}}{_DASH}\d{{3,4}}|0\d{{4}}{_DASH}\d{{2}}{_DASH}\d{{6}}"
    rf"|0\d{{2}}{_SS}\d{{3}}{_SS}\d{{4}}|0\d{{3}}{_SS}\d{{3}}{_SS}\d{{3}}"
    rf"|0\d{{8,10}}"
    rf"|[2-9]\d{{3}}{_SS}\d{{4}}"
    rf"){_EXT}{_N1}",
    re.I,
)

# ---- addresses ----------------------------------------------------------------------------------------------
_WORD = r"[A-ZÀ-ỸĐ][^\W\d_]+"
_NAME = rf"{_WORD}(?:{_SS}{_WORD}){{0,2}}"
_NUM = rf"\d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})?"
_LOC = rf"(?:{_WORD}(?:{_SS}\d{{4,6}})?(?!\w))"
_COMMA = rf"{_S0},{_SS}"
_STREET = r"(?:Street|St\.|St|Road|Rd\.|Rd|Avenue|Ave\.|Ave|Lane|Ln\.|Close|Drive|Crescent|Boulevard|Blvd\.?|Terrace|Way)"
ADDRESS = re.compile(
    rf"(?<![\w/#])(?:"
    # Vietnamese
    rf"(?:số{_SS})?{_NUM}{_SS}(?:đường|phố){_SS}{_NAME}(?:{_COMMA}(?:(?:phường|xã|quận|huyện|thị trấn){_SS})?{_LOC})*"
    rf"|tổ{_SS}\d{{1,3}}{_COMMA}(?:ấp|thôn|khu phố){_SS}{_NAME}(?:{_COMMA}(?:(?:phường|xã|quận|huyện|thị trấn){_SS})?{_LOC})*"
    # Indonesian
    rf"|(?:Jl\.|Jln\.|Jl|Jalan|Kp\.|Kampung|Gg\.){_S0}{_NAME}(?:{_SS}RT{_SS}\d{{1,3}}(?:{_S0}/{_S0}RW{_SS}\d{{1,3}})?)?{_SS}No\.?{_SS}{_NUM}(?:{_SS}RT{_SS}\d{{1,3}}(?:{_S0}/{_S0}RW{_SS}\d{{1,3}})?)?(?:{_COMMA}{_LOC})?"
    rf"|(?:Jl\.|Jln\.|Jl|Jalan){_S0}{_NAME}{_SS}{_NUM}(?!\w)(?:{_COMMA}{_LOC})?"
    rf"|(?:Kp\.|Kampung){_S0}{_NAME}{_SS}RT{_SS}\d{{1,3}}{_S0}/{_S0}RW{_SS}\d{{1,3}}(?:{_COMMA}{_LOC})?"
    # Malay
    rf"|No\.?{_SS}{_NUM}{_COMMA}(?:Lorong|Jalan|Persiaran|Lebuh){_SS}{_NAME}(?:{_SS}\d{{1,3}}(?:/\d{{1,3}})?)?(?:{_COMMA}{_LOC})?"
    # Filipino
    rf"|(?:Blk|Block)\.?{_SS}\d{{1,4}}{_SS}Lot{_SS}\d{{1,4}}(?:{_COMMA}{_NAME}{_SS}(?:Village|Subdivision|Subd\.|Homes))?(?:{_COMMA}(?:Brgy\.{_SS})?{_LOC})?"
    rf"|Purok{_SS}\d{{1,3}}(?:{_COMMA}{_NUM}{_SS}{_NAME}{_SS}{_STREET})?(?:{_COMMA}(?:Brgy\.|Barangay){_SS}{_LOC})(?:{_COMMA}{_LOC})?"
    # Thai
    rf"|{_NUM}{_SS}(?:หมู่(?:ที่)?{_SS}\d{{1,3}}(?:{_SS}(?:ถนน|ถ\.|ซอย|ซ\.){_S0}{_WORD})?|(?:ถนน|ถ\.|ซอย|ซ\.){_S0}{_WORD})(?:{_SS}(?:ตำบล|ต\.|อำเภอ|อ\.|แขวง|เขต)?{_S0}{_WORD}){{0,2}}(?:{_SS}\d{{5}}(?!\d))?"
    # Portuguese
    rf"|(?:Rua|Avenida|Av\.|Travessa|Largo){_SS}(?:d[aeo]s?{_SS})?{_NAME}{_COMMA}(?:n\.?{_S0}[º°o]\.?|no\.){_S0}{_NUM}(?:{_COMMA}{_LOC})?"
    rf"|(?:Aldeia|Bairro){_SS}{_NAME}{_COMMA}(?:casa|n\.?{_S0}[º°o]){_S0}{_NUM}(?:{_COMMA}{_LOC})?"
    # English
    rf"|P\.?{_S0}O\.?{_S0}Box{_SS}\d{{1,5}}(?:{_COMMA}{_LOC})?"
    rf"|(?:Blk|Block|Apt\.?){_SS}\d{{1,4}}[A-Z]?{_SS}\#\d{{1,3}}{_DASH}\d{{1,4}}{_SS}{_NAME}{_SS}{_STREET}(?:{_SS}{_WORD}{_SS}\d{{6}}|{_COMMA}{_LOC})?"
    rf"|(?:(?:Flat|Unit|Apt\.?|Apartment|Room|Suite){_SS}\#?\w{{1,5}}{_COMMA})?(?:(?:House|No\.?){_SS})?{_NUM}{_SS}{_NAME}{_SS}{_STREET}(?!\w)(?:{_COMMA}{_LOC})?"
    rf"|(?:House|Hse\.?|Unit|Flat){_SS}{_NUM}{_COMMA}{_NAME}(?:{_SS}{_STREET})?{_COMMA}{_LOC}"
    rf"|Group{_SS}\d{{1,3}}{_COMMA}{_NAME}(?:{_SS}Village)?(?:{_COMMA}{_LOC})?"
    rf")(?!\w)"
)

# What every address holds (a kind of street or unit).
_ADDRESS_CUE = re.compile(
    r"đường|phố|tổ|Jl|Jalan|Jln|Kp\.|Kampung|Gg\.|Lorong|Persiaran|Lebuh|Blk|Block|Purok|หมู่|ถนน|ถ\.|ซอย|ซ\.|Rua|Av|Travessa|Largo|Aldeia|Bairro|Box|House|Hse|Flat|Unit|Apt|Group|Room|Suite"
    r"|Street|St\b|Road|Rd\b|Lane|Ln\b|Close|Drive|Crescent|Boulevard|Blvd|Terrace|Way\b"
)
_EMAIL_CUE = re.compile(rf"[@＠﹫]|[\[({{<]{_S0}(?:at|arroba)|(?<={_S})at{_SS}(?=[^\W_][^\s]*{_SS}dot{_S})", re.I)
# A run of digits and what may stand between those of one number; every phone and identity number holds one.
_NUMBER_CUE = re.compile(rf"\d[\d().\-−‐-―{_S[1:-1]}]{{5,}}\d")
# What no e-mail address holds.
_EMAIL_STOP = re.compile(rf"(?:(?![\w.+'\-@＠﹫．\[\](){{}}<>]|{_S}).)|\n", re.S)
#: Words that an address may have before its first cue (five in the longest form), and its obligatory words after that (eleven).
_BEFORE_CUE, _AFTER_CUE = 6, 12


def _widest(pattern: re.Pattern) -> int:
    """The most characters that a pattern without unbounded repetition can match."""
    return int(re._parser.parse(pattern.pattern, pattern.flags).getwidth()[1])  # type: ignore[attr-defined]


def _emails(text: str) -> Iterable[re.Match]:
    """E-mail addresses: of each cue, all text up to the nearest characters that no address holds is searched."""
    done = 0
    for cue in _EMAIL_CUE.finditer(text):
        if cue.start() < done:
            continue
        lo, size = done, 64
        while size < cue.start() - done:  # grow to the left until a stop comes into view
            stops = [m.end() for m in _EMAIL_STOP.finditer(text, cue.start() - size, cue.start())]
            if stops:
                lo = stops[-1]
                break
            size *= 4
        else:
            lo = max([done, *[m.end() for m in _EMAIL_STOP.finditer(text, done, cue.start())]])
        stop = _EMAIL_STOP.search(text, cue.end())
        done = stop.start() if stop else len(text)
        yield from EMAIL.finditer(text, lo, done)


def _words_before(text: str, at: int) -> int:
    """A position at least ``_BEFORE_CUE`` words before ``at``, or the beginning of its line."""
    size = 8 * _BEFORE_CUE
    while True:
        lo = max(0, at - size)
        line = text.rfind("\n", lo, at)
        if line >= 0:
            return line + 1
        if lo == 0 or text.count(" ", lo, at) > _BEFORE_CUE:
            return lo
        size *= 2


def _words_after(text: str, at: int) -> int:
    """A position at least ``_AFTER_CUE`` words after ``at``, or the end of its line."""
    size = 8 * _AFTER_CUE
    while True:
        hi = at + size
        line = text.find("\n", at, hi)
        if line >= 0:
            return line
        if hi >= len(text) or text.count(" ", at, hi) > _AFTER_CUE:
            return min(hi, len(text))
        size *= 2


def _proposed(text: str, pattern: re.Pattern, lo: int, hi: int) -> Iterable[re.Match]:
    """Matches that begin between ``lo`` and ``hi``: the stretch proposes where, and the text is then read on from there."""
    while lo < hi and (start := pattern.search(text, lo, hi)):
        whole = pattern.match(text, start.start())
        if whole:
            yield whole
        lo = whole.end() if whole else start.start() + 1


def _addresses(text: str) -> Iterable[re.Match]:
    """Addresses: the words around each cue propose where one begins. No part of an address holds a line break."""
    done = 0
    for cue in _ADDRESS_CUE.finditer(text):
        if cue.start() >= done:
            for m in _proposed(text, ADDRESS, max(done, _words_before(text, cue.start())), _words_after(text, cue.end())):
                yield m
                done = m.end()


def _numbers(text: str, pattern: re.Pattern, cues: Sequence[tuple[int, int]]) -> Iterable[re.Match]:
    """Matches of a pattern of bounded length that holds a number cue, with as much text around the cue as it can take."""
    reach, done = _REACH[pattern], 0
    for start, end in cues:
        for m in _proposed(text, pattern, max(done, start - reach), min(len(text), end + reach)):
            yield m
            done = m.end()


_REACH = {p: _widest(p) + 2 for p in (IDENTITY, PHONE)}  # and what is looked at around a match
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(_S, c))


def _lead(text: str, at: int, size: int = 24) -> str:
    """The text before ``at``, each run of blanks as one, at least ``size`` characters of it."""
    out: list[str] = []
    while at > 0 and len(out) < size:
        at -= 1
        c = text[at]
        if c in _BLANKS:
            c = " "
            while at > 0 and text[at - 1] in _BLANKS:
                at -= 1
        out.append(c)
    return "".join(reversed(out))


# ---- names --------------------------------------------------------------------------------------------------
class NameLexicon:
    """Given and family parts: those listed, and every beginning + ending that listed parts are made of.

    The list is incomplete, so an ending counts if at least ``LEAST`` listed parts end in it with different
    beginnings, a beginning if at least two such parts start with it; every pair of the two is a part.
    """

    LEAST, SHORTEST = 3, 2

    def __init__(self, parts: Iterable[tuple[str, str]]):
        listed: dict[str, set[str]] = {"given": set(), "family": set()}
        for part, position in parts:
            if part and position in listed:
                listed[position].add(part.strip().lower())
        self.affixes: dict[str, tuple[list[str], list[str]]] = {}
        self.split: dict[str, tuple[str, str, str]] = {}
        for position, words in listed.items():
            cuts = [(w, i) for w in words for i in range(self.SHORTEST, len(w) - 1)]
            ends, starts = Counter(w[i:] for w, i in cuts), Counter(w[:i] for w, i in cuts)
            # The cut whose two sides are shared by most other parts.
            best = {w: max(range(self.SHORTEST, len(w) - 1), key=lambda i: ((ends[w[i:]] - 1) * (starts[w[:i]] - 1), i)) for w in words if len(w) > self.SHORTEST + 1}  # noqa: B023
            endings = {e for e, n in Counter(w[i:] for w, i in best.items()).items() if n >= self.LEAST}
            beginnings = {x for x, n in Counter(w[:i] for w, i in best.items() if w[i:] in endings).items() if n >= 2}
            self.affixes[position] = (sorted(beginnings), sorted(endings))
            for b in beginnings:
                for e in endings:
                    self.split.setdefault(b + e, (position, b, e))
            for w in words:
                self.split[w] = (position, w[: best.get(w, len(w))], w[best.get(w, len(w)) :])

        self.automaton = None
        if ahocorasick and self.split:
            self.automaton = ahocorasick.Automaton()
            for word, (position, _, _) in self.split.items():
                self.automaton.add_word(word, (len(word), position))
            self.automaton.make_automaton()

    def parts(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, position) of every whole word that is a part, in any letter case."""
        small = text.lower()
        if self.automaton is None or len(small) != len(text):  # lower case may be longer, which moves positions
            return [(m.start(), m.end(), hit[0]) for m in _LETTERS.finditer(text) if (hit := self.split.get(m.group().lower()))]
        found, n = [], len(text)
        for last, (size, position) in self.automaton.iter(small):
            start, end = last - size + 1, last + 1
            if not (start and text[start - 1].isalpha()) and not (end < n and text[end].isalpha()):
                found.append((start, end, position))
        return found

    def kind(self, word: str) -> str | None:
        hit = self.split.get(word.lower())
        return hit[0] if hit else None


_LETTERS = re.compile(r"[^\W\d_]+")
_JOIN = re.compile(rf"(?:{_SS}|{_S0}{_DASH}{_S0}|{_SS}(?:{'|'.join(map(re.escape, CONNECTORS))}){_SS}|{_SS}[A-Z]\.?{_SS})\Z", re.I)
_COMMA_JOIN = re.compile(rf"{_S0},{_SS}\Z")
_INITIAL_BEFORE = re.compile(rf"(?<![\w.])(?:[A-Z]\.{_S0}){{1,2}}\Z")
_INITIAL_AFTER = re.compile(rf"(?:{_SS}[A-Z]\.){{1,2}}(?!\w)")
_COMMA_INITIAL = re.compile(rf"{_S0},{_SS}(?:[A-Z]\.{_S0}){{1,2}}(?!\w)")
_AFTER = re.compile(rf"(?:'s)?{_SS}(?:{'|'.join(INSTITUTION_AFTER)})\b")
_BEFORE = re.compile(rf"(?:{'|'.join(map(re.escape, sorted(INSTITUTION_BEFORE, key=len, reverse=True)))}){_S0}\Z")
# Every one of these patterns is of bounded length, so looking so far around a name is looking far enough.
_WIDEST_JOIN, _WIDEST_INITIALS, _WIDEST_BEFORE = max(map(_widest, (_JOIN, _COMMA_JOIN))), _widest(_INITIAL_BEFORE), _widest(_BEFORE)


def name_spans(text: str, lexicon: NameLexicon) -> list[Span]:
    """Runs of name parts: at least two, or one with an initial."""
    found = lexicon.parts(text)
    spans, i = [], 0
    while i < len(found):
        start, end, kind = found[i]
        kinds, j = [kind], i + 1
        while j < len(found):
            if found[j][0] - end > _WIDEST_JOIN:
                break
            gap = text[end : found[j][0]]
            comma = kinds[0] == "family" and "given" not in kinds and found[j][2] == "given" and _COMMA_JOIN.match(gap)
            if not (comma or _JOIN.match(gap)):
                break
            end = found[j][1]
            kinds.append(found[j][2])
            j += 1
        initials = 0
        if m := _INITIAL_BEFORE.search(text, max(0, start - _WIDEST_INITIALS), start):
            start, initials = m.start(), 1
        elif m := _INITIAL_AFTER.match(text, end):
            end, initials = m.end(), 1
        elif len(kinds) == 1 and kind == "family" and (m := _COMMA_INITIAL.match(text, end)):
            end, initials = end + len(m.group().rstrip()), 1
        i = j
        if len(kinds) + initials >= 2 and not _AFTER.match(text, end) and not _BEFORE.search(text, max(0, start - _WIDEST_BEFORE), start):
            spans.append(Span("name", start, end))
    return spans


def find_entities(text: str | None, lexicon: NameLexicon) -> list[Span]:
    """All spans of ``text`` in order, none overlapping; null and empty texts have none.

    Where kinds overlap, the more specific form wins: e-mail, identity number, phone, address, name.
    """
    if not text:
        return []
    spans: list[Span] = []
    taken: list[tuple[int, int]] = []

    def offer(new: Iterable[Span]) -> None:
        kept = []
        for s in new:
            at = bisect_left(taken, (s.end, -1))  # spans before it begin earlier than this one ends
            if not (at and taken[at - 1][1] > s.start):
                kept.append(s)
        spans.extend(kept)
        taken.extend((s.start, s.end) for s in kept)
        taken.sort()

    offer(Span("email", m.start(), m.end()) for m in _emails(text))
    offer(Span("address", m.start(), m.end()) for m in _addresses(text))
    cues = [m.span() for m in _NUMBER_CUE.finditer(text)]
    for kind, pattern in (("identity_number", IDENTITY), ("phone", PHONE)):
        offer(Span(kind, m.start(), m.end()) for m in _numbers(text, pattern, cues) if not _OF_THING.search(_lead(text, m.start())))
    offer(name_spans(text, lexicon))
    return sorted(spans, key=lambda s: s.start)
