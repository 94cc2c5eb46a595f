"""Personal data in texts, also where it is disguised: transducers that keep offsets.

A transducer rewrites a text and remembers which source characters each
rewritten stretch stands for, so that a span found in what it wrote can be
taken back to the source.  They are chained; a span goes back through all:

    looks    characters that look like ASCII ones become those, invisible ones go, O and l between digits become 0 and 1
    digits   'four one double five' becomes '4155', in four languages
    signs    '(dot)' or ' dot ' between numbers becomes '.', 'plus' before a digit '+', 'dash' between digits '-'
    address  'name (at) host dot com' becomes 'name@host.com'

The same detector reads the source and the rewritten text.  What it finds in
the source stays as it is found; from the rewritten text come the spans whose
characters were in fact rewritten, that are not inside a span of the source and
that do not reach beyond one over a blank (a word after a number is a word).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_slices

#: Kinds of spans, in the order in which they are told.
KINDS = ("email", "ip", "card", "phone")

# ---- the detector --------------------------------------------------------------------------------------------------------------

# The patterns of the kinds.  Every repetition is followed by a character outside it or takes all it can get, so a
# search reads a text a bounded number of times, whatever it holds; a run that cannot begin a match is passed as a whole.
_LOCAL = "A-Za-z0-9._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)((?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str):
    """From sign to sign: the name before it reaches back to the last match or the last character that no name holds."""
    free, at = 0, text.find("@")
    while at >= 0:
        found = _HOST.match(text, at)
        if found:
            start = at
            while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, found.end()
                free = found.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans, by kind and start: leftmost, not overlapping within a kind, failing ones dropped without a retry."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if m.group(2) and _is_ip(m.group()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- the transducers -----------------------------------------------------------------------------------------------------------


class Rewritten:
    """A text after edits (start, end, replacement), in order and apart from each other, and the way back."""

    def __init__(self, text: str, edits):
        parts, done, at = [], 0, 0
        self.starts, self.ends, self.sources = [], [], []
        for a, b, new in edits:
            parts += (text[done:a], new)
            at += a - done
            self.starts.append(at)
            at += len(new)
            self.ends.append(at)
            self.sources.append((a, b))
            done = b
        self.text = "".join((*parts, text[done:])) if parts else text

    def _back(self, p: int, side: int) -> int:
        """The source's border before (side 0) or after (1) the character at p."""
        i = bisect_right(self.starts, p) - 1
        if i < 0:
            return p + side
        return self.sources[i][side] if p < self.ends[i] else self.sources[i][1] + p - self.ends[i] + side

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start, 0), self._back(end - 1, 1)


# Letters of other scripts and what they look like, by Unicode's list of confusable characters.
LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "γ": "y", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-", "․": ".", "。": ".", "·": ".", "∙": ".", "٫": ".", "＠": "@", "﹫": "@",
}
# Words for digits, signs of an address and of a number, by language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT_WORDS, DOT_WORDS, DASH_WORDS = "at|arroba|arobase", "dot|punkt|point|punto", "dash|hyphen|minus"
INVISIBLE = "\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff"


def _lookalikes() -> dict[int, str]:
    """LOOKS, and by rule: digits of every script, and characters that are compatible with one ASCII letter, blank or sign of an identifier."""
    out = {ord(c): a for c, a in LOOKS.items()}
    for c in map(chr, range(0x80, 0x20000)):
        kind = unicodedata.category(c)
        if kind == "Nd":
            out[ord(c)] = str(unicodedata.digit(c))
        elif kind in ("Ll", "Lu", "Po", "Pd", "Ps", "Pe", "Zs", "Sm", "So"):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in "@.+-_%() []{}"):
                out[ord(c)] = plain
    return out


_LOOKALIKES = _lookalikes()
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_LOOKALIKES) if c < 0x10000) + "\U00010000-\U0001ffff]")
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_LETTER_DIGITS = re.compile(r"[0-9][OolI|]+(?=[0-9])")
_AS_DIGITS = str.maketrans("OolI|", "00111")


def _looks(text: str) -> Rewritten:
    """A rewriting of equal length, with the invisible characters taken out."""
    edits = ()
    if not text.isascii():
        if _ODD.search(text):
            text = text.translate(_LOOKALIKES)
        edits = [(*m.span(), "") for m in _HIDDEN.finditer(text)]
    out = Rewritten(text, edits)
    if _LETTER_DIGITS.search(out.text):
        out.text = _LETTER_DIGITS.sub(lambda m: m.group().translate(_AS_DIGITS), out.text)
    return out


def _either(words) -> str:
    """A pattern of the words by first letter, longer ones first: a search looks at few of them."""
    by = {}
    for w in sorted(words, key=len, reverse=True):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_VALUE = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words.split())} | {"oh": "0"}
_WORDS, _TIMES = _either(_VALUE), {"double": 2, "triple": 3}
_NEXT = rf"[ \t,-]{{1,3}}(?=(?:(?:double|triple)[ \t]+)?{_WORDS}(?![^\W_]))"
_DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:(double|triple)[ \t]+)?({_WORDS})(?![^\W_])({_NEXT})?", re.I)
#: A word for a digit with a digit, another such word or a disguised dot beside it; for lower-case texts.
_SPELLED = re.compile(rf"{_WORDS}(?:{_NEXT}|[ \t,.-]{{1,3}}[0-9]|[ \t]{{0,3}}[(\[{{<]|[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]|\.{_WORDS})|[0-9][ \t,.-]{{1,3}}{_WORDS}")


def _digits(text: str) -> Rewritten:
    """Words for digits; what stands between two of them goes with the first.  A lone 'oh' is a word like others."""
    edits, chained = [], []
    for m in _DIGIT_WORD.finditer(text):
        value = _VALUE[m.group(2).lower()]
        chained.append((m.start(), m.end(), value * _TIMES.get((m.group(1) or "").lower(), 1), m.group(2).lower() == "oh"))
        if m.group(3) is None:
            if not all(c[3] for c in chained):
                edits += [c[:3] for c in chained]
            chained = []
    return Rewritten(text, edits)


_DOT = rf"(?:[ \t]{{0,3}}[(\[{{<][ \t]?(?:{DOT_WORDS}|\.)[ \t]?[)\]}}>][ \t]{{0,3}}|[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]{{1,3}}|\.)"
_BRACKETS = re.compile(rf"[(\[{{<][ \t]?(?:{AT_WORDS}|{DOT_WORDS}|a|@|\.)[ \t]?[)\]}}>]")
_BARE = re.compile(rf"[ \t](?:{DOT_WORDS})[ \t]|[0-9][ \t]{{0,3}}(?:{DASH_WORDS})|plus[ \t-]{{0,3}}\(?[0-9]")
_WIDE_AT = re.compile(r"[ \t]@|@[ \t]")


def _hinted(low: str) -> bool:
    """Whether a lower-case text has anything that the last two transducers rewrite."""
    if any(w in low for w in f"{DOT_WORDS}|{DASH_WORDS}|plus".split("|")) and _BARE.search(low):
        return True
    return "@" in low and bool(_WIDE_AT.search(low)) or bool(_BRACKETS.search(low))


_SIGNS = re.compile(
    rf"(?<![A-Za-z0-9.])(?P<quad>[0-9]+(?:{_DOT}[0-9]+){{3}})(?![0-9])"
    rf"|(?P<plus>\bplus[ \t-]{{0,3}})(?=\(?[0-9])"
    rf"|(?<=[0-9])(?P<dash>[ \t]{{0,3}}(?:{DASH_WORDS})[ \t]{{0,3}})(?=[0-9])",
    re.I,
)
_A_DOT = re.compile(_DOT, re.I)


def _signs(text: str) -> Rewritten:
    edits = []
    for m in _SIGNS.finditer(text):
        if m.group("plus"):
            edits.append((*m.span("plus"), "+"))
        elif m.group("dash"):
            edits.append((*m.span("dash"), "-"))
        else:
            edits += [(*d.span(), ".") for d in _A_DOT.finditer(text, *m.span("quad")) if d.group() != "."]
    return Rewritten(text, edits)


_ADDRESS = re.compile(
    rf"(?<![{_LOCAL}])[A-Za-z0-9_%+-][{_LOCAL}]*+(?:{_DOT}[{_LOCAL}]++){{0,8}}"
    rf"(?P<at>[ \t]{{0,3}}[(\[{{<][ \t]?(?:{AT_WORDS}|a|@)[ \t]?[)\]}}>][ \t]{{0,3}}|[ \t]{{1,3}}(?P<bare>{AT_WORDS})[ \t]{{1,3}}|[ \t]{{0,3}}@[ \t]{{0,3}})"
    rf"(?P<host>[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9-])",
    re.I,
)


def _address(text: str) -> Rewritten:
    """Names, signs and hosts; a bare ' at ' counts only before a host whose dots are disguised, as words of a sentence meet it too."""
    edits = []
    for m in _ADDRESS.finditer(text):
        dots = [d for d in _A_DOT.finditer(text, *m.span("host"))]
        if m.group("bare") and all(d.group() == "." for d in dots):
            continue
        own = [(*d.span(), ".") for d in _A_DOT.finditer(text, m.start(), m.start("at")) if d.group() != "."]
        edits += own + ([(*m.span("at"), "@")] if m.group("at") != "@" else [])
        edits += [(*d.span(), ".") for d in dots if d.group() != "."]
    return Rewritten(text, edits)


def chain(text: str) -> list[Rewritten]:
    """What the transducers make of a text, one after another; one that finds nothing to rewrite is left out."""
    out = [_looks(text)]
    if _SPELLED.search(out[-1].text.lower()):
        out.append(_digits(out[-1].text))
    if _hinted(out[-1].text.lower()):
        out.append(_signs(out[-1].text))
        out.append(_address(out[-1].text))
    return out


def _new(text: str, start: int, end: int, own: list[tuple[int, int]]) -> bool:
    """Whether a span adds to those that the source shows: it is not inside one, and reaches beyond one only over characters that are not blank."""
    return not any(s < end and start < e and (s <= start and end <= e or re.search(r"\s", text[start:s] + text[e:end])) for s, e in own)


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether the source shows it as it stands) by kind, start and end."""
    base = detect(text)
    out = [(*x, True) for x in base]
    steps = chain(text)
    clear = steps[-1].text
    if clear != text:
        own = [[x[1:] for x in base if x[0] == kind] for kind in range(len(KINDS))]
        added = set()
        for kind, a, b in detect(clear):
            start, end = a, b
            for step in reversed(steps):
                start, end = step.source(start, end)
            near = own[kind][max(0, bisect_right(own[kind], (start,)) - 1) : bisect_right(own[kind], (end,))]
            if text[start:end] != clear[a:b] and _new(text, start, end, near):
                added.add((kind, start, end, False))
        out += added
    return sorted(out)


def masked(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with '[KIND]' in place of the spans; overlapping ones become one, of the kind that begins first."""
    parts, done = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e, _ in found):
        if start >= done:
            parts += (text[done:start], f"[{KINDS[kind].upper()}]")
        done = max(done, -end)
    return "".join((*parts, text[done:]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _found(batches, mask: bool):
    for part in text_slices(batches, 1):
        texts = part.column(1).to_pylist()
        rows = [spans(t) for t in texts]
        flat = [x for r in rows for x in r]
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        columns = [pa.array([KINDS[x[0]] for x in flat], pa.string()), *[pa.array([x[i] for x in flat], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.bool_()))]]
        values = pa.StructArray.from_arrays(columns, fields=list(_SPAN))
        out = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]
        names = ["id", "spans"]
        if mask:
            out.append(pa.array([masked(t, r) for t, r in zip(texts, rows)], pa.string()))
            names.append("masked")
        del texts, rows, flat
        yield pa.RecordBatch.from_arrays(out, names=names)
        give_back()


def find(docs: DataFrame, mask: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans), a row for each row of docs; spans: array of kind, start, end (code points, end exclusive) and base, by kind and start.

    base: the source shows the identifier as it stands; the others were found
    in what the transducers made of it.  mask: also the text with '[EMAIL]',
    '[IP]', '[CARD]' or '[PHONE]' in place of the spans.  A null text is empty
    and has no spans; null ids and repeated rows stay; a text is searched whole
    whatever its length, in time that grows with it; an empty table gives no
    rows; other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>" + (", masked string" if mask else "")
    return rows.mapInArrow(lambda batches: _found(batches, mask), schema)
