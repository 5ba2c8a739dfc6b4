"""Garbled text from a wrong character encoding: round-trip repair.

Text is re-encoded under candidate legacy encodings and strictly decoded as UTF-8, sequence by sequence, so that a record may
be garbled wholly or in places. The encoding that lowers the garbling cost most is accepted and the step is repeated for
nested layers, until no encoding lowers the cost.

What counts as a reading
------------------------
A sequence that decodes to a letter, sign or ideograph of the scripts in use here counts by itself. One that decodes to a
letter of another script counts only if the text has several of that script. Code pages that are rare here are tried on whole
lines, which must be encodable and then valid UTF-8 of one script from end to end. UTF-8 readings come before readings of text
that was stored in a legacy page itself; those need signs of the language. A text counts as wholly restored only if garbling
it again gives back what was there; wherever a lost byte was guessed, something remains.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings under which UTF-8 may have been read. ``western`` is Windows-1252 whose bytes 0x80-0x9F may also stand
#: as the control characters of ISO 8859-1.
ENCODINGS = ("western", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r")
#: The other direction: text stored in this Vietnamese code page and read as ``western``.
VIETNAMESE = "cp1258"
#: And text stored in this Chinese code page and read as ``western``: runs of at least four letters and signs.
CHINESE = "gbk"
#: Code pages tried on whole lines that have at least so many characters beyond ASCII.
LINE_PAGES, LINE_CHARS = ("western", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp932", "gbk", "big5", "cp949"), 4
#: Scripts whose letters count where a text has several of them, by their first and last code point (fixed values).
SCRIPTS = {"latin": ((0x100, 0x17F),), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x530, 0x58F),),
           "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)), "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),),
           "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),), "kana": ((0x3040, 0x30FF),), "hangul": ((0xAC00, 0xD7AF),), "han": ((0x4E00, 0x9FFF),)}
#: How many sequences of another script a text must have: of Latin letters and ideographs, and of any other.
SEVERAL_LATIN, SEVERAL = 2, 4
_CHINESE_RUN = "[\u00a1-\u00fe]{4,}"
#: What a decoded sequence may be: letters of Latin scripts in use here, their marks, punctuation, symbols, CJK and emoji.
PLAUSIBLE = re.compile(
    "[\u00a0-\u00ff\u0102\u0103\u0110\u0111\u0128\u0129\u0152\u0153\u0160\u0161\u0168\u0169\u0178\u017d\u017e\u0192\u01a0\u01a1\u01af\u01b0"
    "\u02c6\u02dc\u0300-\u0304\u0306\u0308\u0309\u031b\u0323\u0327\u1ea0-\u1ef9\u2000-\u206f\u20a0-\u20bf\u2100-\u218f\u2190-\u22ff\u2500-\u27bf"
    "\u3000-\u303f\ufb00-\ufb06\ufe0f\ufeff\uff00-\uffef\ufffd\U0001f000-\U0001faff]")
_LOWER = "a-z\u00df-\u00f6\u00f8-\u00ff\u0103\u0111\u01a1\u01b0\u1ea1-\u1ef9"
#: Signs of garbling that no sequence shows: control and replacement characters, a capital A with tilde after a small letter
#: (its second byte was a no-break space), the torn start of a three-byte letter, letters of a code page read as another.
_SIGNS = (f"[\u0080-\u0084\u0086-\u009f\ufffd]|(?<=[{_LOWER}])\u00c3|\u00e1[\u00ba\u00bb]|[\u00d0\u00de\u00f0\u00fe]|(?<=[{_LOWER}])[\u00cc\u00d2]")
_OPEN, _CLOSE = "\u201c\u201e\"\u00ab\u2018'`(\u300c\u300e", "\u201d\u201c\"\u00bb\u2019'`)\u300d\u300f"
#: A quoted example: a quotation of a few characters, none of them ASCII.
_QUOTED = re.compile(f"(?<=[{re.escape(_OPEN)}])[ \u00a0\u202f]?[^\x00-\x7f]{{1,12}}?[ \u00a0\u202f]?(?=[{re.escape(_CLOSE)}])")
#: Characters of the Chinese page in common use lie in these rows of it; of a run at least so many must.
_COMMON_ROWS, _COMMON = (0xB0, 0xD7), 0.7
#: The other eastern page, its rows of syllables, and how many characters of either or of that one a text must have.
KOREAN, _SYLLABLE_ROWS, LEAST_EAST, LEAST_KOREAN = "euc_kr", (0xB0, 0xC8), 4, 8


@lru_cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """The bytes 0x80-0xFF by their characters."""
    known: dict[str, int] = {}
    for b in range(0x80, 0x100):
        if encoding == "western" and b < 0xA0:
            known[chr(b)] = b
        try:
            known[bytes([b]).decode("cp1252" if encoding == "western" else encoding)] = b
        except UnicodeDecodeError:  # an undefined byte mostly passes as a control character
            known[chr(b)] = b
    return known


def _class(chars: set[str]) -> str:
    """A character class of ranges."""
    codes, parts = sorted(map(ord, chars)), []
    while codes:
        n = 1
        while n < len(codes) and codes[n] == codes[0] + n:
            n += 1
        parts.append(f"\\u{codes[0]:04x}-\\u{codes[n - 1]:04x}")
        codes = codes[n:]
    return "[" + "".join(parts) + "]"


def _chars(encoding: str, low: int, high: int) -> set[str]:
    return {c for c, b in _bytes_of(encoding).items() if low <= b <= high}


def sequence_pattern(encoding: str) -> str:
    """What UTF-8 sequences of two to four bytes look like under ``encoding``."""
    two, three, four, tail = (_class(_chars(encoding, *x)) for x in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4), (0x80, 0xBF)))
    return f"{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}}"


_PATTERN = {e: re.compile(sequence_pattern(e)) for e in ENCODINGS}
_LEADS, _TAILS = ({e: _chars(e, *x) for e in ENCODINGS} for x in ((0xC2, 0xF4), (0x80, 0xBF)))
_SIGN = re.compile(_SIGNS)
_LOST_SPACE = re.compile(f"(?<=[{_LOWER}])\u00c3 ")
_READ_AS = {c: char for c, b in _bytes_of("western").items() if (char := bytes([b]).decode(VIETNAMESE, "ignore"))}
_PAGE = re.compile(f"[\u00d0\u00de\u00f0\u00fe]|(?<=[{_LOWER}])[\u00cc\u00d2]")


@lru_cache(maxsize=65_536)
def _decoded(encoding: str, sequence: str) -> tuple[str, str | None] | None:
    """The character that a sequence stands for and, if it is none that counts by itself, its script."""
    by = _bytes_of(encoding)
    try:
        char = bytes(by[c] for c in sequence).decode("utf-8", "strict")
    except UnicodeDecodeError:
        return None
    if "\u0080" <= char <= "\u009f" or PLAUSIBLE.fullmatch(char):
        return char, None
    script = script_of(char)
    return (char, script) if script else None


@lru_cache(maxsize=65_536)
def script_of(char: str) -> str | None:
    if unicodedata.category(char) in ("Cn", "Co", "Cs"):
        return None
    return next((name for name, parts in SCRIPTS.items() if any(a <= ord(char) <= b for a, b in parts)), None)


_EAST = ("cp932", "gbk", "big5", "cp949")
_RARE = tuple(p for p in LINE_PAGES if p not in ENCODINGS and p not in _EAST)
_VIETNAMESE_ALPHABET = re.compile("[\u00e0-\u00e3\u00e8-\u00ea\u00ec\u00ed\u00f2-\u00f5\u00f9\u00fa\u00fd\u0103\u0111\u0129\u0169\u01a1\u01b0\u1ea0-\u1ef9]", re.I)
_VIETNAMESE_LETTERS = re.compile("[\u0103\u0111\u01a1\u01b0\u1ea0-\u1ef9]", re.I)
#: What a line of UTF-8 read as one of the pages must show: a lead and a tail of a single-byte page, or two ideographs or kana.
_LINE_SIGNS = "|".join(_class(_chars(p, 0xC2, 0xEF)) + _class(_chars(p, 0x80, 0xBF)) for p in _RARE) + "|[\u4e00-\u9fff\uff61-\uff9f]{2}|[\uac00-\ud7a3]"
_LINEWISE = re.compile(_LINE_SIGNS)
_RUN, _SHORT_RUN = re.compile(_CHINESE_RUN), re.compile("[\u00a1-\u00fe]{2,}")
_HAN = re.compile("[\u4e00-\u9fff\uac00-\ud7a3\u3000-\u303f\uff00-\uffef]+")


def _syllables(rows: list[int]) -> bool:
    return all(_SYLLABLE_ROWS[0] <= b <= _SYLLABLE_ROWS[1] for b in rows)


def _eastern(text: str) -> str | None:
    """The eastern page in which a text or parts of it were stored; None without enough characters that speak for one."""
    runs = [m[0].encode("latin-1") for m in _SHORT_RUN.finditer(text) if len(m[0]) % 2 == 0 and not _mostly_utf8(m[0])]
    rows = [b for raw in runs for b in raw[::2]]
    if sum(len(raw) // 2 for raw in runs if len(raw) >= 4) < LEAST_EAST:
        return None
    if len(rows) >= LEAST_KOREAN and _syllables(rows):
        return KOREAN
    letters = [b for b in rows if b >= _COMMON_ROWS[0]]  # rows below hold signs
    return CHINESE if sum(b <= _COMMON_ROWS[1] for b in letters) >= _COMMON * len(letters) else None


@lru_cache(maxsize=65_536)
def _mostly_utf8(run: str) -> bool:
    return 2 * sum(len(m[0]) for m in _PATTERN["western"].finditer(run) if _decoded("western", m[0])) > len(run)


@lru_cache(maxsize=65_536)
def _stored(run: str, page: str) -> str | None:
    """What a run stands for in an eastern page; None if it doesn't decode or is mostly UTF-8 read as ``western``."""
    if _mostly_utf8(run):
        return None
    try:
        text = run.encode("latin-1").decode(page, "strict")
    except UnicodeDecodeError:
        return None
    return text if _HAN.fullmatch(text) else None


@lru_cache(maxsize=4096)
def _line(line: str, page: str) -> str | None:
    """A whole line read as ``page`` instead of UTF-8; None unless it is valid UTF-8 of one script from end to end."""
    if sum(c > "\x7f" for c in line) < LINE_CHARS:
        return None
    try:
        if page not in _EAST:
            by = _bytes_of(page)
            raw = bytes(by[c] if c > "\x7f" else ord(c) for c in line)
        else:
            raw = line.encode(page)
        text = raw.decode("utf-8", "strict")
    except (UnicodeError, KeyError):
        return None
    own = {script_of(c) or ("here" if PLAUSIBLE.match(c) else "none") for c in text if c > "\x7f" and unicodedata.category(c)[0] == "L"}
    others = own - {"here", "latin"} - ({"kana", "han"} if "kana" in own else set())
    if not own or "none" in own or len(others) > 1:
        return None
    for script in others:  # its letters stand in words, not one by one between letters of others
        letters = [script_of(c) == script for c in text]
        if sum(letters) < 2 * sum(b and not a for a, b in zip([False, *letters], letters)):
            return None
    return text


def _several(text: str, encoding: str) -> frozenset[str]:
    """The scripts of which a text has several letters under ``encoding``, if that reads most of what is beyond ASCII; of others than Latin and ideographs the most frequent one."""
    counts, covered = Counter(), 0
    for m in _PATTERN[encoding].finditer(text):
        if found := _decoded(encoding, m[0]):
            covered += len(m[0])
            if found[1]:
                counts[found[1]] += 1
    if not counts or 2 * covered < sum(c > "\x7f" for c in text):  # a text in the script would be garbled in most of its letters
        return frozenset()
    found = {script for script in ("latin", "han") if counts.pop(script, 0) >= SEVERAL_LATIN}
    if counts and max(counts.values()) >= SEVERAL:
        found.add(max(counts, key=counts.get))
    return frozenset(found)


def _meant(m: re.Match, encoding: str, scripts: frozenset[str]) -> str | None:
    """The character that a sequence stands for; None if the text may mean the sequence itself.

    A capital with a no-break space between capitals is a word of a heading and the space behind it. A control character is
    the middle of a letter that was garbled before: it is one in itself or follows the rest of that letter.
    """
    found = _decoded(encoding, m[0])
    char = found[0] if found and (found[1] is None or found[1] in scripts) else None
    if char and char <= "\u009f" and char != m[0][-1] and m.string[m.start() - 1 : m.start()] not in _TAILS[encoding]:
        return None
    if char and m[0][-1] == "\u00a0" and m[0][0].isupper() and m.string[m.end() : m.end() + 1].isupper() and m.string[m.start() - 1 : m.start()].isupper():
        return None
    return char


def _possible(text: str) -> list[str]:
    chars = {c for c in set(text) if c > "\x7f"}
    return [e for e in ENCODINGS if not chars.isdisjoint(_LEADS[e]) and not chars.isdisjoint(_TAILS[e])]


def cost(text: str) -> int:
    """Characters in sequences that some encoding decodes plausibly, or that are signs by themselves, outside quoted examples."""
    whole, text = text, _QUOTED.sub(lambda m: " " * len(m[0]), text)
    spots = {m.start() for m in _SIGN.finditer(text)}
    if page := _eastern(text):
        spots.update(i for m in _RUN.finditer(text) if _stored(m[0], page) for i in range(m.start(), m.end()))
    for e in _possible(text):
        scripts = _several(text, e)
        for m in _PATTERN[e].finditer(text):
            if _meant(m, e, scripts):
                spots.update(range(m.start(), m.end()))
    if _LINEWISE.search(text):
        at = 0
        for line, unquoted in zip(whole.split("\n"), text.split("\n")):
            if sum(c > "\x7f" for c in unquoted) >= LINE_CHARS and any(_line(line, page) for page in LINE_PAGES):
                spots.update(i for i, c in enumerate(line, at) if c > "\x7f")
            at += len(line) + 1
    return len(spots)


def _undo(text: str, encoding: str, whole: bool = False) -> tuple[str, int]:
    """(the text read anew, how many of its characters are guesses: garbling them again wouldn't give back what was there)."""
    if whole:
        return "\n".join(_line(line, encoding) or line for line in text.split("\n")), 0
    if encoding == VIETNAMESE:  # only sentences that show it: other letters mean themselves in either page
        parts, guesses = re.split(r"(?<=[.;?!])(?=\s)|(?<=\n)", text), 0
        for i, part in enumerate(parts):
            if _PAGE.search(part):
                new = unicodedata.normalize("NFC", "".join(_READ_AS.get(c, c) for c in part))
                letters = [c for c in new if c > "\x7f" and c.isalpha()]
                if len(_VIETNAMESE_LETTERS.findall(new)) > len(_VIETNAMESE_LETTERS.findall(part)) and all(map(_VIETNAMESE_ALPHABET.match, letters)):
                    guesses += sum(c > "\x7f" and c not in _READ_AS for c in part)
                    parts[i] = new
        return "".join(parts), guesses
    if encoding in (CHINESE, KOREAN):  # short runs beside long ones are of the same page
        if _eastern(text) != encoding:
            return text, 0
        rows = [b for m in _SHORT_RUN.finditer(text) for b in m[0].encode("latin-1")[::2]]
        return _SHORT_RUN.sub(lambda m: _stored(m[0], encoding) or m[0], text), int(encoding == CHINESE and _syllables(rows))  # few of them may be either
    scripts = _several(text, encoding)
    text = _PATTERN[encoding].sub(lambda m: _meant(m, encoding, scripts) or m[0], text)
    if encoding != "western":
        return text, 0
    text, a = _LOST_SPACE.subn("\u00e0", text)
    return text.replace("\u00e1\u00ba ", "\u1ea0"), a + text.count("\u00e1\u00ba ")


def repair(text: str) -> tuple[int, list[str], str, int]:
    """(cost before, encodings undone from the outside in, text after, cost after and guesses made)."""
    before = now = cost(text)
    undone: list[str] = []
    guessed = 0
    while now:  # each layer lowers the cost, so there are at most that many
        best = None
        # whole lines first, then sequences, then pages in which the text itself was stored
        for encodings, whole in ((LINE_PAGES, True), (_possible(text), False), ((KOREAN, CHINESE, VIETNAMESE), False)):
            for e in encodings:
                new, guesses = _undo(text, e, whole)
                if new != text and (c := cost(new)) < now and (best is None or c < best[0]):
                    best = c, e, new, guesses
            if best and (best[0] == 0 or not whole):
                break
        if best is None:
            break
        now, e, text, guesses = best
        guessed += guesses
        undone.append(e)
    return before, undone, text, now + guessed


def suspicious() -> str:
    """A pattern that every text with a positive cost matches, for Spark's own filter; ASCII is passed over at once."""
    return rf"(?=[^\u0000-\u007f])(?:{'|'.join(map(sequence_pattern, ENCODINGS))}|{_CHINESE_RUN}|{_SIGNS}|{_LINE_SIGNS})"


def find_garbled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, cost, layers, restored, remaining``: one row for each record whose text is garbled somewhere.

    ``layers`` are the encodings undone from the outside in, ``restored`` the repaired text where repair lowered the cost
    (null where nothing could be restored), ``remaining`` the cost that is left and the guesses made: 0 means wholly restored and
    that garbling the result again gives the text; replacement characters cannot be. Null, empty and blank texts are not garbled, nor are texts that only quote garbled sequences,
    have decomposed or missing accents, or hold other scripts and symbols. Rows are judged one by one, so repeated rows and null
    ids stay. Whole texts are read. Other columns are ignored.

    A filter inside the JVM passes only texts with a suspicious sequence to Python; it is implied by a positive cost.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                before, undone, after, left = repair(text)
                if before:
                    keep.append(i)
                    found.append((before, undone, after if undone else None, left))
            a, b, c, d = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.list_(pa.string())), pa.array(c, pa.string()), pa.array(d, pa.int32())],
                [id_col, "cost", "layers", "restored", "remaining"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").rlike(suspicious())).mapInArrow(
        run, f"`{id_col}` {id_type}, cost int, layers array<string>, restored string, remaining int")
