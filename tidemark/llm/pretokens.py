"""Where a byte-level tokenizer's pattern cuts texts, found without regular expressions.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ws L N]+|ws+(?!non-ws)|ws+`` with L letters, N numbers and ws white
space. Every code point is looked up in a class table. A text's classes drive a small automaton; each class is a
transition function on its states, functions compose associatively, and so the states at all positions come from a
scan: blocks of classes are composed side by side, the blocks' functions are combined by doubling, and a second pass
fills in the states. Boundaries then follow from each position's class, state and neighbours.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import arrowtext as at

# Symbols: other letters, numbers, the space, other white space, the rest, the apostrophe, letters that can follow it, row borders.
LETTER, NUMBER, SPACE, WHITE, OTHER, APOSTROPHE, S_T_M_D, R, V, L, E, BREAK = range(12)
# States, by what was read last: nothing or white space, a letter, number, other, space, an apostrophe that may begin
# a contraction, the same with r, v or l read, a finished contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = STATES = range(10)
BLOCK = 512
#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Symbol of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    for letters, symbol in (("stmd", S_T_M_D), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in letters]] = symbol
    return table


def _is_letter(symbol: int) -> bool:
    return symbol in (LETTER, S_T_M_D, R, V, L, E)


def _next(symbol: int, state: int) -> int:
    if symbol == BREAK or symbol == WHITE:
        return FRESH
    if symbol == SPACE:
        return AFTER_SPACE
    if symbol == NUMBER:
        return IN_NUMBERS
    if symbol == OTHER:
        return IN_OTHER
    if symbol == APOSTROPHE:
        return IN_OTHER if state in (IN_OTHER, AFTER_SPACE, QUOTE) else QUOTE
    if state == QUOTE:
        return {S_T_M_D: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(symbol, IN_LETTERS)
    if (state, symbol) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        return DONE
    return IN_LETTERS


def _begins(symbol: int, state: int) -> bool:
    """Whether a token begins at a symbol that is not white space, read in a state."""
    if symbol == BREAK or state == AFTER_SPACE:
        return False
    if _is_letter(symbol):
        return state not in (IN_LETTERS, QUOTE_R, QUOTE_V, QUOTE_L)
    if symbol == NUMBER:
        return state != IN_NUMBERS
    return state not in (IN_OTHER, QUOTE)


NEXT = np.array([[_next(c, s) for s in STATES] for c in range(12)], np.uint8).ravel()
BEGINS = np.array([[c not in (SPACE, WHITE) and _begins(c, s) for s in STATES] for c in range(12)]).ravel()
_N = len(STATES)


def states(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state after each symbol, from FRESH."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, BREAK, np.int32)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * _N
    through = np.repeat(np.arange(_N, dtype=np.uint8)[:, None], blocks, axis=1)
    for column in columns:  # each block's function from the state before it to the state after it
        through = NEXT[column + through]
    reach = 1
    while reach < blocks:  # functions of ever longer runs of blocks
        through[:, reach:] = np.take_along_axis(through[:, reach:], through[:, :-reach].astype(np.int64), axis=0)
        reach *= 2
    state = np.concatenate([[FRESH], through[FRESH, :-1]]).astype(np.uint8)
    out = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        state = out[k] = NEXT[column + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def boundaries(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens begin in texts that lie back to back (offsets: n + 1 starts)."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80)
    rows = np.unique(np.searchsorted(at_byte, offsets[:-1]))
    rows = rows[rows < len(points)]
    symbols = np.insert(classes()[points], rows, BREAK)
    after = states(symbols)
    before = np.concatenate([[FRESH], after[:-1]]).astype(np.uint8)
    begins = BEGINS[symbols.astype(np.int32) * _N + before]
    following = np.concatenate([symbols[1:], [BREAK]])
    finished = np.concatenate([after[1:], [FRESH]]) == DONE
    unfinished = (after >= QUOTE_R) & (after <= QUOTE_L)
    contraction = (before == QUOTE) & ((after == DONE) | (unfinished & finished))
    begins &= ~contraction
    white = (symbols == SPACE) | (symbols == WHITE)
    white_next = (following == SPACE) | (following == WHITE)
    previous = np.concatenate([[BREAK], symbols[:-1]])
    white_before = (previous == SPACE) | (previous == WHITE)
    begins |= white & (~white_before | (~white_next & (following != BREAK)))
    return at_byte[np.delete(begins, rows + np.arange(len(rows)))]


def pieces_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(first row, row offsets, data, starts, row of each start) of a few megabytes at a time.

    A longer text is cut before white space that follows another character, where a token always begins."""
    data, offsets = at.bytes_of(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + at.SLICE_BYTES, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[stop])
        if end - begin <= 2 * at.SLICE_BYTES:
            spans = [(begin, end)]
        else:
            spans, k = [], begin
            while k < end:
                m = min(end, k + at.SLICE_BYTES)
                if m < end:
                    space = at.SPACE[data[m:end]] & ~at.SPACE[data[m - 1 : end - 1]] & (data[m - 1 : end - 1] < 0x80)
                    m = m + int(np.argmax(space)) if space.any() else end
                spans.append((k, m))
                k = m
        for k, m in spans if end > begin else ():
            raw = data[k:m].tobytes()
            local = np.clip(offsets[first : stop + 1], k, m) - k
            starts = boundaries(raw, local)
            yield first, local, raw, starts, np.searchsorted(local, starts, "right") - 1
        first = stop
