"""Personal data in texts, plain or disguised, with spans in the source text.

Plain identifiers are found by their patterns. Then transducers rewrite what disguises
them: characters that look like ASCII ones, digits spelled out, and words or brackets that
stand for @, dots, plus and dashes. Each rewriting keeps a list of its edits, so a span
found in the rewritten text leads back, edit list by edit list, to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]
#: start, end, replacement
Edit = tuple[int, int, str]

# Plain identifiers. A search at each place of a long run would take quadratic time, so runs are taken from their start.
# Patterns begin with a set of characters and look back after it, since a search then skips to these characters.

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            if (doubled + sum(map(int, digits[::-2]))) % 10 == 0:
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


# Rewriting.


class Rewritten:
    """A text with edits made (they don't overlap, and are in order), and the way back."""

    def __init__(self, source: str, edits: list[Edit]):
        parts, at, out = [], 0, 0
        self.starts: list[int] = []
        self.edits: list[tuple[int, int, int, int]] = []
        for start, end, new in edits:
            parts += source[at:start], new
            out += start - at
            self.starts.append(out)
            self.edits.append((out, out + len(new), start, end))
            out, at = out + len(new), end
        self.text = "".join((*parts, source[at:]))

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source's span of a span here, and whether an edit lies in it."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a = self._place(first, start, False)
        b = self._place(last, end - 1, True)
        inner = any(self.edits[i][1] > start for i in (first,) if i >= 0) or last > first
        return a, b, inner

    def _place(self, i: int, at: int, closing: bool) -> int:
        if i < 0:
            return at + closing
        out_start, out_end, start, end = self.edits[i]
        if at < out_end:
            return end if closing else start
        return end + at - out_end + closing


#: Letters of other scripts, and signs, that look like ASCII ones and that no Unicode decomposition leads to.
LOOKALIKES = {
    "Cyrillic": ("АВЕКМНОРСТУХЅІЈԚԜЗаеорсухѕіјԛԝһԁ", "ABEKMHOPCTYXSIJQW3aeopcyxsijqwhd"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορτυχ", "ABEZHIKMNOPTYXaivoptux"),
    "Armenian and others": ("օոսցՕՍɡɑɩıⅼ", "onugOUgaiil"),
    "signs": ("․。·•∙⋅‧⁃−➕✚", ".......--++"),
}
_FIXED = {ord(a): b for old, new in LOOKALIKES.values() for a, b in zip(old, new, strict=True)}


class _Plain(dict):
    """Code points to their plain form: a character, or nothing for invisible ones."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind, form = unicodedata.category(c), unicodedata.normalize("NFKC", c)
        if code in _FIXED:
            out = _FIXED[code]
        elif kind == "Cf" or 0xFE00 <= code <= 0xFE0F:
            out = ""
        elif kind == "Zs":
            out = " "
        elif kind == "Pd":
            out = "-"
        elif (value := unicodedata.digit(c, None)) is not None:
            out = str(value)
        else:
            out = form if len(form) == 1 and form.isascii() else c
        self[code] = out
        return out


_PLAIN = _Plain()
#: Beyond ASCII and the letters of Latin-1.
_FOREIGN = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")


def plain_characters(text: str) -> list[Edit]:
    """Lookalikes, compatibility forms, digits of any script, spaces and dashes as ASCII; invisible characters go."""
    if text.isascii():
        return []
    return [(m.start(), m.end(), new) for m in _FOREIGN.finditer(text) if (new := _PLAIN[ord(m[0])]) != m[0]]


_NUMBER = re.compile(r"[0-9]+")


def letters_for_digits(text: str) -> list[Edit]:
    """O and l among digits as 0 and 1, where a token holds nothing else."""
    edits: list[Edit] = []
    done = 0
    for m in _NUMBER.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and text[start - 1] in "OolI":
            start -= 1
        while end < len(text) and text[end] in "OolI0123456789":
            end += 1
        done = end
        if end - start > m.end() - m.start() and not (start and text[start - 1].isalpha()) and not (end < len(text) and text[end].isalpha()):
            edits += [(i, i + 1, "0" if text[i] in "Oo" else "1") for i in range(start, end) if text[i] in "OolI"]
    return edits


#: The words of digits by language.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_VALUE = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words.split())} | {"oh": "0", "fuenf": "5"}
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DOT_WORD = "(?i:dot|punkt|punto|point)"
_DOT_SIGN = rf"\s{{0,3}}{_OPEN}\s{{0,2}}(?:{_DOT_WORD}|\.)\s{{0,2}}{_SHUT}\s{{0,3}}|\s{{1,3}}{_DOT_WORD}\s{{1,3}}|_{_DOT_WORD}_"
_BY_LETTER = {a: "|".join(sorted((w[1:] for w in _VALUE if w[0] == a), key=len, reverse=True)) for a in sorted({w[0] for w in _VALUE})}
_WORD = "(?:" + "|".join(f"[{a}{a.upper()}](?i:{rest})" for a, rest in _BY_LETTER.items()) + ")"
_GAP = rf"(?:[\s,-]{{1,2}}|(?P<dot>{_DOT_SIGN})|\s{{1,3}}(?i:dash|hyphen|minus)\s{{1,3}})"
_SPELLED = re.compile(rf"\b{_WORD}(?:{_GAP.replace('?P<dot>', '?:')}{_WORD})+\b")
_STEP = re.compile(rf"(?P<word>{_WORD})(?:{_GAP}(?={_WORD}))?")


def spelled_digits(text: str) -> list[Edit]:
    """Runs of two or more digit words as digits side by side; what stands for a dot between them stays one."""
    return [(*m.span(), _VALUE[m["word"].lower()] + "." * bool(m["dot"])) for run in _SPELLED.finditer(text) for m in _STEP.finditer(text, *run.span())]


_DOT = re.compile(rf"{_DOT_SIGN}|\.")
_DOT_BEFORE = re.compile(rf"(?:{_DOT_SIGN})\Z")
_AT = re.compile(
    rf"[Aa@](?:(?<=@)|(?<![^\W_][Aa])(?<=[Aa])(?:[Tt]|(?i:rroba|robase))(?![^\W_]))(?P<after>[\s\])}}>_*]{{0,6}})(?P<domain>[A-Za-z0-9-]++(?:(?:{_DOT_SIGN}|\.)[A-Za-z0-9-]++)+)"
)
#: Last parts of domains that a disguise without brackets must end in.
_LAST = frozenset("com org net edu gov mil int info biz io ai app dev co me tv us uk ca au nz de fr es it nl be ch at eu pl ru ua jp cn kr in br mx ar cl se no dk fi pt gr cz ie example test".split())


def disguised_emails(text: str) -> list[Edit]:
    """at and dot, in words or brackets, as @ and full stops, where they make an address.

    A bracketed sign, or an @ set apart, needs a last part of two letters or more. The word
    at between spaces is common: it needs a known last part, and a dot in words too or a
    name with a digit, dot, dash or underscore before it.
    """
    edits: list[Edit] = []
    done = 0
    for m in _AT.finditer(text):
        at, after = m.start(), m["after"]
        literal = text[at] == "@"
        left = at
        while left > max(done, at - 6) and (text[left - 1] in "[({<_*" or text[left - 1].isspace()):
            left -= 1
        before = text[left:at]
        if not literal and not (before and after):
            continue
        bare = not literal and not (before.strip() and after.strip())
        last = re.split(r"[^A-Za-z0-9-]+", m["domain"])[-1]
        if bare and last.lower() not in _LAST or not re.fullmatch(r"[A-Za-z]{2,24}", last):
            continue
        dots = [d for d in _DOT.finditer(m["domain"]) if d[0] != "."]
        own: list[Edit] = []
        start = left
        while True:
            atom = start
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start == atom:
                break
            # The sign itself is never longer than this window.
            sign = _DOT_BEFORE.search(text[max(done, start - 20) : start])
            if not sign:
                break
            begin = start - len(sign[0])
            if begin <= done or text[begin - 1] not in _LOCAL:
                break
            own.insert(0, (begin, start, "."))
            start = begin
        if start == left:
            continue
        if bare and (text[left - 1] == "." or not dots and not own and not re.search(r"[0-9._-]", text[start:left])):
            continue
        if before or after or not literal:
            own.append((left, m.start("domain"), "@"))
        own += [(m.start("domain") + d.start(), m.start("domain") + d.end(), ".") for d in dots]
        edits += own
        done = m.end()
    return edits


_BETWEEN = re.compile(rf"[0-9](?:(?P<dot>{_DOT_SIGN})|\s{{1,3}}(?i:dash|hyphen|minus)\s{{1,3}}|\s{{0,3}}{_OPEN}-{_SHUT}\s{{0,3}})(?=[0-9(])")
_PLUS = re.compile(rf"[\[({{<Pp+](?:(?<=\+)(?=\s)|(?<=[Pp])(?<![^\W_].)(?i:lus)\b|(?<=[\[({{<])\s{{0,2}}(?i:plus|\+)\s{{0,2}}{_SHUT})\s{{0,3}}(?=[0-9(])")


def signs_in_numbers(text: str) -> list[Edit]:
    """dot, dash and plus, in words or brackets, beside digits as signs."""
    edits = [(m.start() + 1, m.end(), "." if m["dot"] else "-") for m in _BETWEEN.finditer(text)]
    return sorted(edits + [(*m.span(), "+") for m in _PLUS.finditer(text)])


STAGES = (plain_characters, letters_for_digits, spelled_digits, disguised_emails, signs_in_numbers)


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """kind, start, end, base of all spans, by kind as in KINDS, then start, end; code points, end exclusive.

    A span of the rewritten text is added if an edit lies in it and no plain span of its kind
    covers it. Plain numbers are blanked before the rewriting, so it makes none of them longer.
    """
    if not text:
        return []
    base = {kind: list(f(text)) for kind, f in FINDERS.items()}
    found = {(kind, start, end): True for kind, spans in base.items() for start, end in spans}
    numbers = [(start, end, "\0" * (end - start)) for start, end in _united(sorted(s for kind in KINDS[1:] for s in base[kind]))]
    now, chain = Rewritten(text, numbers).text, []
    for stage in STAGES:
        if edits := stage(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    if chain:
        for kind, f in FINDERS.items():
            for start, end in f(now):
                edited = False
                for step in reversed(chain):
                    start, end, inner = step.back(start, end)
                    edited |= inner
                if edited and not any(a <= start and end <= b for a, b in base[kind]):
                    found.setdefault((kind, start, end), False)
    return [(*key, own) for key, own in sorted(found.items(), key=lambda x: (KINDS.index(x[0][0]), *x[0][1:]))]


def _united(spans: list[Span]) -> list[Span]:
    """Sorted spans with overlapping ones as one."""
    out: list[Span] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, spans (kind, start, end, base) of each row, spans by kind, then start.

    Texts are read whole, a long one in the task that holds its row; work grows in
    proportion to a text. A null or empty text has no spans. Rows that repeat an id or text,
    or have no id, each get a row. An empty table gives none. More columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch.column("text")
            spans = [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in find(texts[i].as_py())] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, item)], ["id", "spans"])

    own = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return own.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
