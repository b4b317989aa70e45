"""Sentence units of Markdown texts in any script, by a finite transducer.

Lines are sorted into blocks first (front matter, fenced code, headings, items, quotes, paragraphs). Inside a block the
places that can matter (end marks, quotes, brackets, white space between Thai letters) become letters. A letter only says
what stands at its place: the kind of mark, the class of the word before it, the class of what follows. Whether a
sentence ends there is said by `RULES`, which are compiled, together with the states (outside; just after a boundary;
inside an enclosure that opened at the start of a sentence or within it), into the table of a transducer.

Enclosures may nest to any depth and mix: partners are matched with a stack, and only the outermost pair of a nest is
given to the transducer, as nothing inside it can end a sentence. A document with many letters is cut into chunks: each
chunk becomes a function from state to state, the functions are composed by a parallel prefix scan, and then every chunk
writes its boundaries from the state it starts in.

Defined results: null, empty and blank texts give no unit; every other character than white space lies in exactly one
unit, in order; equal texts give equal units. An unclosed fence runs to the end of the text, an unclosed front matter is
text, an opening quotation or bracket without a partner in its block is an ordinary character.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters of a document that are read as one chunk.
CHUNK = 256

# Abbreviations that public style guides list, lower case, without the last dot.
#: A sentence never ends after these.
NEVER = frozenset(
    "dr mr mrs ms prof st sr sra srta dra mme mlle mm hr fr frau herr jun sen rev gen col capt lt sgt hon vs approx ca cf e.g i.e viz ver resp al"
    " z bzw evtl ggf ebd inkl exkl usw-dgl vgl sog d.h z.b u.a s.o p.ej p.ex ej ex ee d m c-a-d т г-н им ул проф акад د डॉ श्री प्रो".split()
)
#: Of these, what stands before a name: before a word that opens sentences they end one.
BEFORE_NAMES = frozenset("dr mr mrs ms prof st jun sen rev gen col capt lt sgt hon vs resp".split())
#: Words that open sentences and are no names.
OPENERS = frozenset("the this that these those it he she we they you there here then when while if but and so thus however dies diese dieser dann wenn es er wir aber und".split())
#: A sentence doesn't end after these before a number.
NUMBERED = frozenset(
    "no nos nr núm num fig figs abb sec secs sect art arts ch chap vol p pp pág págs pg par § eq tab taf kap bd n nº l'art s стр рис гл табл см п ст ver v rev item vers jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic okt dez".split()
)
#: A sentence may end after these, but only before a capital or an uncased letter.
ORDINAL_AFTER = frozenset("am im zum zur vom der die das dem den des beim bis ab seit jeder jede jedes jedem jeden ins pro".split())

MARKS = ".!?…。！？．｡।॥؟۔"
_STRONG = frozenset("。！？．｡")
_ALWAYS = frozenset("।॥؟۔")
_CLOSERS = "\"”“»」』)）]】》〉’"
_SKIPPED = frozenset(" \t\r\n >\"“„«「『(（[【《〈¿¡*_'‘`​‍  　\x0b\x0c\x85    ")
_DASHES = frozenset("-–—−")
_THAI = r"[ก-ฺเ-๎๚๛]"
_HAS_THAI = re.compile(_THAI)
_EVENT = re.compile(rf"[{MARKS}]+|[\"“”„«»「」『』()（）\[\]【】《》〈〉]")
_EVENT_THAI = re.compile(rf"[{MARKS}]+|[\"“”„«»「」『』()（）\[\]【】《》〈〉]|(?<={_THAI})\s+(?:>\s*)*(?={_THAI})")
_CLOSE_RUN = re.compile(rf"[{re.escape(_CLOSERS)}]*")
_LINE = re.compile(
    r"[^\S\n]*(?:(?P<blank>$)|(?P<head>#{1,6}(?=\s|$))|(?P<fence>`{3,}|~{3,})"
    r"|(?P<quote>>[> \t]*)?(?P<item>(?:[-*+•]|(?P<n>\d{1,9})[.)])(?=[ \t ]+\S))?)"
)
_SPACE = re.compile(r"\s*")

#: Enclosures: how they open (kind, partners that close them) and close (kind). Kind 1 is the straight quotation mark.
_PAIRS = {"“": 2, "„": 2, "«": 3, "「": 4, "『": 5, "《": 6, "〈": 6, "(": 7, "（": 7, "[": 7, "【": 7}
_ENDS = {"”": 2, "»": 3, "」": 4, "』": 5, "》": 6, "〉": 6, ")": 7, "）": 7, "]": 7, "】": 7}
STRAIGHT, CURLY, BRACKET = 1, 2, 7
_BEFORE_STRAIGHT = frozenset("([{¿¡„“«>—–-*_（「：，。！？、")
_BETWEEN = " \t\r\n >\"”»」』)）]】"
_NOT_WORD = frozenset("\"“„«([（「『>")

# what follows a place
END, GLUED, GLUED_UNCASED, UPPER, OPENER, LOWER, UNCASED, DIGIT, DASH, OTHER = range(10)
# kinds of end mark: always; exclamation and question; a single dot; another run of marks
ALWAYS, ASKS, DOT, RUN = range(4)
# the word before a dot: its shape, besides whether it is in NEVER, BEFORE_NAMES, NUMBERED
WORD, INITIAL, LETTER, LETTER_AFTER_DOT, ORDINAL = range(5)
PLAIN, NEVER_ENDS, NEEDS_NAME = range(3)

_GLUED = {GLUED, GLUED_UNCASED}
_CAPITAL = {UPPER, OPENER}
#: (kinds of mark, condition on (abbreviation, numbered, shape), what follows, whether a sentence ends there); the first that fits decides. None fits all.
RULES = (
    ({ALWAYS}, None, None, True),
    ({ASKS}, None, {GLUED, DASH}, False),
    ({ASKS}, None, None, True),
    ({RUN}, None, {END, UPPER, OPENER, UNCASED, DIGIT, OTHER}, True),
    ({RUN}, None, None, False),
    ({DOT}, None, {GLUED, GLUED_UNCASED, LOWER, DASH}, False),
    ({DOT}, None, {END}, True),
    ({DOT}, lambda abbreviation, numbered, shape: abbreviation == NEEDS_NAME, {OPENER}, True),
    ({DOT}, lambda abbreviation, numbered, shape: abbreviation != PLAIN, None, False),
    ({DOT}, lambda abbreviation, numbered, shape: numbered, {DIGIT}, False),
    ({DOT}, lambda abbreviation, numbered, shape: shape in (INITIAL, LETTER_AFTER_DOT, ORDINAL), _CAPITAL, False),
    ({DOT}, None, None, True),
)
#: (bracket, opened at the start of a sentence, what follows, whether a closer after an end mark ends the sentence); as above. "wide" is a full-width bracket.
CLOSING = (
    ({"quote"}, None, {UPPER, OPENER, DIGIT, OTHER}, True),
    ({"bracket", "wide"}, True, {UPPER, OPENER, DIGIT, OTHER, UNCASED, GLUED_UNCASED}, True),
    ({"wide"}, True, {GLUED}, True),
    ({"quote", "bracket", "wide"}, None, None, False),
)
_SORTS = ("quote", "bracket", "wide")

RESET, BREAK, OPEN = 0, 1, 2  # an opening is OPEN, or OPEN + 1 if nothing but blanks and closers is before it
_FIRST_MARK = 4
_FIRST_CLOSE = _FIRST_MARK + 4 * 3 * 2 * 5 * 10
LETTERS = _FIRST_CLOSE + 3 * 2 * 10


def _mark(kind: int, abbreviation: int, numbered: bool, shape: int, after: int) -> int:
    return _FIRST_MARK + (((kind * 3 + abbreviation) * 2 + numbered) * 5 + shape) * 10 + after


def _close(sort: int, marked: bool, after: int) -> int:
    return _FIRST_CLOSE + (sort * 2 + marked) * 10 + after


#: States: outside; outside just after a boundary; inside an enclosure within a sentence; inside one that began it.
OUTSIDE, FRESH, INSIDE, INSIDE_FRESH = range(4)
STATES = 4


def _compiled() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a boundary is written) for each state and letter, from the rules."""
    go = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, LETTERS))
    out = np.zeros((STATES, LETTERS), dtype=bool)
    go[:, RESET] = FRESH
    for state in (OUTSIDE, FRESH):
        go[state, BREAK], out[state, BREAK] = FRESH, True
        go[state, OPEN] = INSIDE
        go[state, OPEN + 1] = INSIDE_FRESH if state == FRESH else INSIDE
    for kind in range(4):
        for abbreviation in range(3):
            for numbered in (False, True):
                for shape in range(5):
                    for after in range(10):
                        ends = next(e for kinds, said, follow, e in RULES if kind in kinds and (said is None or said(abbreviation, numbered, shape)) and (follow is None or after in follow))
                        letter = _mark(kind, abbreviation, numbered, shape, after)
                        go[:2, letter], out[:2, letter] = FRESH if ends else OUTSIDE, ends
    for sort, name in enumerate(_SORTS):
        for marked in (False, True):
            for after in range(10):
                for state in (INSIDE, INSIDE_FRESH):
                    ends = marked and next(e for sorts, began, follow, e in CLOSING if name in sorts and (began is None or began == (state == INSIDE_FRESH)) and (follow is None or after in follow))
                    letter = _close(sort, marked, after)
                    go[state, letter], out[state, letter] = FRESH if ends else OUTSIDE, ends
    return go, out


GO, OUT = _compiled()
_GO, _OUT = GO.tolist(), OUT.tolist()


def follows(text: str, at: int, end: int) -> int:
    """What comes after a place in a block."""
    if at >= end:
        return END
    c = text[at]
    if not c.isspace():
        return GLUED_UNCASED if c.isalpha() and not (c.islower() or c.isupper() or c.istitle()) else GLUED
    while at < end and text[at] in _SKIPPED or at < end and text[at].isspace():
        at += 1
    if at >= end:
        return END
    c = text[at]
    if c.isupper() or c.istitle():
        stop = at
        while stop < end and stop - at <= _LONGEST and text[stop].isalpha():
            stop += 1
        return OPENER if text[at:stop].lower() in OPENERS else UPPER
    if c.islower():
        return LOWER
    if c.isalpha():
        return UNCASED
    if c.isdigit():
        return DIGIT
    return DASH if c in _DASHES else OTHER


#: No listed word is longer, so what is longer need not be read to its start.
_LONGEST = max(map(len, NEVER | NUMBERED | ORDINAL_AFTER | OPENERS))


def _word_before(text: str, start: int, at: int) -> str:
    """The word that ends at a place; one that is longer than any listed word is cut off."""
    low = at
    while low > start and at - low <= _LONGEST and text[low - 1] not in _NOT_WORD and not text[low - 1].isspace():
        low -= 1
    return text[low:at]


def _before_dot(text: str, start: int, at: int) -> tuple[int, bool, int]:
    """(abbreviation, numbered, shape) of the word before a dot."""
    own = _word_before(text, start, at)
    word = own.lower()
    abbreviation = PLAIN if word not in NEVER else NEEDS_NAME if word in BEFORE_NAMES else NEVER_ENDS
    shape = WORD
    if len(word) == 1 and word.isalpha():
        if own.isupper():
            shape = INITIAL
        elif own.islower() and word != "д":
            shape = LETTER
            low = at - 1
            while low > start and text[low - 1].isspace():
                low -= 1
            if low - 1 > start and text[low - 1] == "." and text[low - 2].isalpha() and not (low - 3 >= start and text[low - 3].isalpha()):
                shape = LETTER_AFTER_DOT
    elif word.isdigit() and len(word) <= 2:
        low = at - len(word)
        while low > start and text[low - 1].isspace():
            low -= 1
        if _word_before(text, start, low).lower() in ORDINAL_AFTER:
            shape = ORDINAL
    return abbreviation, word in NUMBERED, shape


def _outermost(text: str, start: int, end: int, found: list[re.Match]) -> dict[int, bool]:
    """Places of the enclosure marks that open (True) or close (False) an outermost pair."""
    stack: list[tuple[int, str, int]] = []
    pairs: list[tuple[int, int]] = []
    straight = sum(m.group() == '"' for m in found)
    for m in found:
        c, at = m.group(), m.start()
        if c[0] in MARKS or c[0].isspace():
            continue
        if c == '"':
            straight -= 1
            before = text[at - 1] if at > start else " "
            opening = (before.isspace() or before in _BEFORE_STRAIGHT) and straight > 0
            kind = STRAIGHT
            if opening and any(k == STRAIGHT for k, _, _ in stack):
                continue
        else:
            kind, opening = (_PAIRS[c], True) if c in _PAIRS else (_ENDS[c], False)
            if c == "“":
                # it closes a low mark
                opening = next((o != "„" for k, o, _ in reversed(stack) if k == CURLY), True)
        if opening:
            stack.append((kind, c, at))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == kind:
                pairs.append((stack[i][2], at))
                del stack[i:]
                break
    out: dict[int, bool] = {}
    reach = -1
    for low, high in sorted(pairs):
        if low > reach:
            out[low], out[high] = True, False
            reach = high
    return out


def _letters(text: str, start: int, end: int, event: re.Pattern, letters: array, places: list[int]) -> None:
    """Appends the letters of a block, and after each the place where a boundary would fall."""
    letters.append(RESET)
    places.append(start)
    found = list(event.finditer(text, start, end))
    enclosing = _outermost(text, start, end, found)
    last = start
    for m in found:
        c, at = m.group(), m.start()
        head = c[0]
        if head in MARKS:
            stop = _CLOSE_RUN.match(text, m.end(), end).end()
            after = follows(text, stop, end)
            marks = set(c)
            if marks & _STRONG or marks & _ALWAYS:
                letter = _mark(ALWAYS, PLAIN, False, WORD, after)
            elif marks & {"!", "?"}:
                letter = _mark(ASKS, PLAIN, False, WORD, after)
            elif c == ".":
                letter = _mark(DOT, *_before_dot(text, start, at), after)
            else:
                letter = _mark(RUN, PLAIN, False, WORD, after)
            letters.append(letter)
            places.append(stop)
            last = stop
        elif head.isspace():
            letters.append(BREAK)
            places.append(at)
            last = at
        elif at in enclosing:
            if enclosing[at]:
                letters.append(OPEN + (not text[last:at].strip(_BETWEEN)))
                places.append(at)
                last = m.end()
                continue
            inner = at
            while inner > start and text[inner - 1].isspace():
                inner -= 1
            bracket = _ENDS.get(head) == BRACKET
            stop = m.end() if head == '"' else _CLOSE_RUN.match(text, m.end(), end).end()
            letters.append(_close((2 if head in "）】" else 1) if bracket else 0, inner > start and text[inner - 1] in MARKS, follows(text, stop, end)))
            places.append(stop)
            last = stop


def run_transducer(letters: array, chunk: int = CHUNK) -> list[int]:
    """Indices of the letters at which boundaries are written."""
    n = len(letters)
    if n <= chunk:
        return _run(letters, OUTSIDE, 0, n)
    starts = list(range(0, n, chunk))
    padded = np.full(len(starts) * chunk, LETTERS, dtype=np.int64)
    padded[:n] = np.frombuffer(letters, dtype=np.uint16)
    padded = padded.reshape(len(starts), chunk)
    # one more letter that keeps every state, for the end of the last chunk
    table = np.concatenate([GO, np.arange(STATES, dtype=np.uint8)[:, None]], axis=1)
    functions = np.tile(np.arange(STATES, dtype=np.uint8), (len(starts), 1))
    for k in range(chunk):
        functions = table[functions, padded[:, k : k + 1]]
    # inclusive scan: after step d each function spans 2 * d chunks
    d = 1
    while d < len(starts):
        later = np.take_along_axis(functions[d:], functions[:-d].astype(np.int64), axis=1)
        functions = np.concatenate([functions[:d], later])
        d *= 2
    begin = [OUTSIDE, *functions[:-1, OUTSIDE].tolist()]
    return [i for s, state in zip(starts, begin, strict=True) for i in _run(letters, state, s, min(n, s + chunk))]


def _run(letters: array, state: int, low: int, high: int) -> list[int]:
    found = []
    for i in range(low, high):
        c = letters[i]
        if _OUT[state][c]:
            found.append(i)
        state = _GO[state][c]
    return found


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, start of the content, end) of each block; content -1 for blocks that are one unit."""
    out: list[tuple[int, int, int]] = []
    n, at = len(text), 0
    first = _SPACE.match(text).end()
    if text.startswith("---", first):
        stop = text.find("\n", first)
        if stop >= 0 and not text[first:stop].strip()[3:]:
            close = re.compile(r"^[^\S\n]*---[^\S\n]*$", re.M).search(text, stop + 1)
            if close:
                out.append((first, -1, close.end()))
                at = close.end()
    fence = ""
    fence_start = 0
    open_at = content = -1  # of the running text block
    quoted = False
    number = 0
    loose = True

    def flush(end: int) -> None:
        nonlocal open_at
        if open_at >= 0:
            out.append((open_at, content, end))
            open_at = -1

    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        m = _LINE.match(text, at, stop)
        kind = m.lastgroup
        if fence:
            mark = m.group("fence")
            if mark and mark[0] == fence[0] and len(mark) >= len(fence) and not text[m.end() : stop].strip():
                out.append((fence_start, -1, stop))
                fence = ""
        elif m.group("fence"):
            flush(at)
            fence, fence_start, loose = m.group("fence"), at, True
        elif kind == "blank" or not text[at:stop].strip():
            flush(at)
            loose, quoted = True, False
        elif m.group("head"):
            flush(at)
            out.append((at, -1, stop))
            loose, quoted, number = True, False, 0
        else:
            item = m.group("item")
            if item and m.group("n"):
                k = int(m.group("n"))
                if not (loose or k == 1 or k == number + 1):
                    item = None
                else:
                    number = k
            is_quote = m.group("quote") is not None
            if item or open_at < 0 or is_quote and not quoted:
                flush(at)
                if not item and not is_quote:
                    number = 0
                open_at = at
                content = m.end() if item or is_quote else at
            quoted, loose = is_quote, False
        at = stop + 1
    if fence:
        out.append((fence_start, -1, n))
    flush(n)
    return out


def units(text: str | None, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """(start, end) of each unit."""
    if not text or text.isspace():
        return []
    parts = blocks(text)
    letters, places, owner = array("H"), [], []
    event = _EVENT_THAI if _HAS_THAI.search(text) else _EVENT
    for k, (_, content, end) in enumerate(parts):
        if content >= 0:
            before = len(letters)
            _letters(text, content, end, event, letters, places)
            owner.extend([k] * (len(letters) - before))
    cuts: list[list[int]] = [[] for _ in parts]
    for i in run_transducer(letters, chunk):
        cuts[owner[i]].append(places[i])
    found = []
    for (start, _, end), inner in zip(parts, cuts, strict=True):
        at = start
        for cut in [*inner, end]:
            if cut <= at:
                continue
            low, high = _trim(text, at, cut)
            if low < high:
                found.append((low, high))
            at = cut
    return found


def _trim(text: str, low: int, high: int) -> tuple[int, int]:
    low = _SPACE.match(text, low, high).end()
    while high > low and text[high - 1].isspace():
        high -= 1
    return low, high


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char) of every unit of column `text`. One pass, no shuffle; other columns play no part."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, low, high = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in units(t):
                    rows.append(i)
                    low.append(a)
                    high.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
                names=["k", "start_char", "end_char"],
            )

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, start_char int, end_char int").withColumnRenamed("k", key)
