"""Pre-tokenisation by code-point classes and an associative scan of transition functions.

The split pattern of byte-level BPE is a small automaton over code-point classes with one or two characters of
look-ahead. Look-ahead is folded into the class of a character, so that what remains is a deterministic automaton: each
character is a function from the state before it to the state after it. Functions compose associatively, and only a few
dozen distinct ones arise, so a composition is one look-up in a table of function numbers. `scan` computes all prefixes
in two levels of blocks; the state before a character then tells whether a match starts there. No regular expression
runs over the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

# Classes of a character after look-ahead.
LETTER, NUMBER, OTHER, JOIN, LAST, WHITE, QUOTE2, QUOTE3, RESET = range(9)
# States: what kind of match is open. CUT: the next character starts a match. ONE, TWO: that many letters of a
# contraction are due. PREFIX: a space that the next run takes in.
CUT, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, PREFIX, ONE, TWO = range(8)
STATES = 8
#: Plain classes of code points, before look-ahead.
P_LETTER, P_NUMBER, P_OTHER, P_WHITE, P_RESET = 0, 1, 2, 3, 4
#: Stands between texts of a batch; it isn't a code point.
SENTINEL = 0x110000
BLOCK = 64


def _next_state(state: int, symbol: int) -> int:
    if symbol == RESET:
        return CUT
    if state == TWO:
        return ONE
    if state == ONE:
        return CUT
    if symbol in (QUOTE2, QUOTE3) and state not in (IN_OTHER, PREFIX):
        return ONE if symbol == QUOTE2 else TWO
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, JOIN: PREFIX, LAST: CUT, WHITE: IN_WHITE}.get(symbol, IN_OTHER)


def _starts(state: int, symbol: int) -> bool:
    """Whether a character of this class starts a match if it is met in this state."""
    if symbol == RESET or state == CUT:
        return True
    if state in (ONE, TWO):
        return False
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, WHITE: IN_WHITE, OTHER: IN_OTHER, QUOTE2: IN_OTHER, QUOTE3: IN_OTHER}.get(symbol)
    return not (state == run or state == PREFIX and symbol in (LETTER, NUMBER, OTHER, QUOTE2, QUOTE3))


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that compositions of the classes' functions reach: (composition table, number of each class, images)."""
    basic = [tuple(_next_state(s, symbol) for s in range(STATES)) for symbol in range(9)]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *basic]))}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in basic:
            if (h := tuple(g[x] for x in f)) not in number:
                number[h] = len(number)
                todo.append(h)
    functions = list(number)
    table = np.array([[number.get(tuple(g[x] for x in f), 0) for g in functions] for f in functions], np.int32)
    return table, np.array([number[f] for f in basic], np.int32), np.array(functions, np.uint8)


COMPOSE, OF_CLASS, IMAGES = _monoid()
COUNT = len(IMAGES)
FLAT = COMPOSE.ravel().astype(np.uint16 if COUNT > 256 else np.uint8)
START_TABLE = np.array([[_starts(s, symbol) for symbol in range(9)] for s in range(STATES)])


def scan(functions: np.ndarray) -> np.ndarray:
    """All prefix compositions: out[i] is functions[0], then functions[1], ... then functions[i]."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.astype(np.int32)
        for i in range(1, n):
            out[i] = FLAT[out[i - 1] * COUNT + out[i]]
        return out
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.int32)  # 0 is the identity
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        columns[i] = FLAT[columns[i - 1] * COUNT + columns[i]]
    before = np.zeros(rows, np.int32)
    before[1:] = scan(columns[-1])[:-1]
    return FLAT[before[None, :] * COUNT + columns].T.reshape(-1)[:n].astype(np.int32)


def classify(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes with look-ahead of the code points of a batch; `classes` holds the plain class of every code point."""
    plain = classes[points]
    after = np.append(plain[1:], np.uint8(P_RESET))
    out = plain.astype(np.uint8)
    white = plain == P_WHITE
    out[white] = WHITE
    ends = white & (after != P_WHITE) & (after != P_RESET)
    out[ends] = LAST
    out[ends & (points == 0x20)] = JOIN
    out[plain == P_RESET] = RESET
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, [SENTINEL, SENTINEL])
        a, b = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE2
        three = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quotes[three]] = QUOTE3
    return out


def match_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which positions of a batch (texts with SENTINEL between them) start a match; a SENTINEL does."""
    symbols = classify(points, classes)
    prefixes = scan(OF_CLASS[symbols])
    before = np.zeros(len(points), np.uint8)  # the state CUT
    before[1:] = IMAGES[prefixes[:-1], CUT]
    return START_TABLE[before, symbols]


def split_batch(texts: list[str], classes: np.ndarray, limit: int = 1 << 20) -> list[list[str]]:
    """The matches of each text, in order. Texts go through the scan together, about `limit` characters at a time."""
    out: list[list[str]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < limit):
            size += len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        points = np.full(size, SENTINEL, np.uint32)
        place, firsts = 0, []
        for text in group:
            firsts.append(place)
            points[place : place + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            place += len(text) + 1
        starts = np.flatnonzero(match_starts(points, classes))
        cuts = np.searchsorted(starts, firsts)
        for k, (text, first) in enumerate(zip(group, firsts, strict=True)):
            last = cuts[k + 1] if k + 1 < len(group) else len(starts)
            own = (starts[cuts[k] : last] - first).tolist()  # the last one is the sentinel, the end of the text
            out.append([text[i:j] for i, j in zip(own, own[1:])])
        at = end
    return out


def class_table(members: Callable[[str, str], set[str]]) -> bytes:
    """Plain classes of all code points, compressed. members(pattern, characters) gives those that a library matches."""
    characters = "".join(chr(i) for i in range(SENTINEL) if not 0xD800 <= i < 0xE000)
    table = np.full(SENTINEL + 1, P_OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", P_LETTER), (r"\p{N}", P_NUMBER), (r"\s", P_WHITE)):
        table[[ord(c) for c in members(pattern, characters)]] = kind
    table[SENTINEL] = P_RESET
    return zlib.compress(table.tobytes(), 9)


def unpack_classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)
