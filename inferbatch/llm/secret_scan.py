"""Secrets in texts: three base patterns, and a linear-chain conditional random field over tokens.

Base patterns find assignments to names of secrets, access-key ids and long hexadecimal runs. The field adds
what they miss. A text becomes tokens: runs of letters, digits, `_`, `+` and `/`, and every other visible
character by itself. Each token is the begin of a secret, inside one, or outside. Features are

* its shape: make-up (cases, digits, symbols), length, changes between letters and digits and between cases,
  the share of vowels, what stands before it (nothing, a blank, a line end), each with the make-up;
* words: the token itself, if it is in the vocabulary, and, for shapes that may hold a secret, the words up to
  `REACH` places around it and the make-up of the neighbours;
* the file: the shares of digits and of signs in the whole text, for tokens of eight characters and more.

The field has a weight per feature and tag and one per pair of neighbouring tags, fitted by gradient ascent
on the exact likelihood, and is decoded by Viterbi. Some sequences are ruled out, in training as well: a secret
begins at a token whose shape may hold one (`capable`), inside follows begin or inside only, and no blank lies
between. So all tokens between blanks are outside unless one of them can begin a secret, and Viterbi runs
over the others' stretches only, with the same result as over the whole text.

Labelled sequences are windows of texts of at most `most_docs` documents (those with the smallest hash of
their id), a documented bound. What the base patterns find in them is a secret; into copies of the windows
seeded secrets of many forms are written, and as often harmless look-alikes (plain words after names of
secrets, numbers, dates, paths, identifiers), which stay outside. Scanning reads every whole text.

Spans are (kind, start, end) in code points, end exclusive; base spans stay as they are, and a span of the
field that lies within a base span is not repeated. Ordered by start, then kind.

Defined results: a null or empty text has no spans; the place of a span does not depend on other rows, so
repeated rows and texts give equal spans; an empty table gives an empty result; without any document
to learn from, stock phrases fill the windows; only the named columns are read. Characters are
taken in pieces of `PIECE` characters, cut between tokens, so memory grows with the tokens of one text only.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of the names in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
STEMS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "field")

PIECE = 1 << 20
REACH = 3
MOST_DOCS = 2_000
WINDOW = 12
WINDOWS = 2_000
VOCABULARY = 600
SEED = 11
STEPS = 80
RATE = 0.15
RIDGE = 0.3
# Added to "outside" at each token when decoding, in nats.
CAUTION = 1.0

OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the base patterns find, leftmost and without overlap for each kind."""
    out = []
    # Case folding can only add hits here; the pattern itself decides.
    low = text.lower()
    if any(stem in low for stem in STEMS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- tokens -----------------------------------------------------------------------

BLANK, LOWER, UPPER, DIGIT, WIDE, JOINER, SIGN = range(7)


# Blanks beyond ASCII; other characters beyond it are letters of some script.
BLANKS = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]


def _character_classes() -> np.ndarray:
    table = np.full(1 << 16, WIDE, np.uint8)
    table[:128], table[BLANKS] = SIGN, BLANK
    for chars, kind in (
        (string.ascii_lowercase, LOWER), (string.ascii_uppercase, UPPER), (string.digits, DIGIT), ("_+/", JOINER),
        ("".join(map(chr, [*range(33), 127])), BLANK),
    ):
        table[[ord(c) for c in chars]] = kind
    return table


# Character codes beyond these count like the last one.
CLASSES = _character_classes()
VOWELS = np.zeros(1 << 16, bool)
VOWELS[[ord(c) for c in "aeiouyAEIOUY"]] = True
HASH_BASE = np.uint64(1_099_511_628_211)
LENGTHS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 32, 40, 64])

# Make-up of a token.
MAKEUPS = 16
(M_SIGN, M_QUOTE, M_COLON, M_EQUALS, M_DOT, M_DASH, M_DIGITS, M_LOWER, M_CAPITAL, M_UPPER, M_MIXED, M_LOWER_DIGIT,
 M_UPPER_DIGIT, M_MIXED_DIGIT, M_JOINED, M_WIDE) = range(MAKEUPS)


SIGN_MAKEUPS = np.full(128, M_SIGN)
for _signs, _makeup in (("\"'`", M_QUOTE), (":", M_COLON), ("=", M_EQUALS), (".", M_DOT), ("-", M_DASH)):
    SIGN_MAKEUPS[[ord(_c) for _c in _signs]] = _makeup


@dataclass
class Tokens:
    """Tokens of one text: places, make-up, shape number and hash of each, and the features of the file."""

    start: np.ndarray
    end: np.ndarray
    makeup: np.ndarray
    length: np.ndarray
    changes: np.ndarray
    vowels: np.ndarray
    before: np.ndarray
    word: np.ndarray
    file: tuple[int, int]


def _pieces(codes: np.ndarray, classes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut between tokens: where a character is no part of a run with the one before it."""
    start = 0
    while start < len(codes):
        end = min(len(codes), start + most)
        while end < len(codes):
            part = (classes[end - 1 : end + most] != BLANK) & (classes[end - 1 : end + most] != SIGN)
            free = np.flatnonzero(~(part[:-1] & part[1:]))
            if len(free):
                end += int(free[0])
                break
            end = min(len(codes), end + most)
        yield start, end
        start = end


def tokens(text: str, piece: int = PIECE) -> Tokens:
    """The tokens of a text, from whole arrays of its characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = CLASSES[np.minimum(codes, 0xFFFF)]
    visible = max(1, int((classes != BLANK).sum()))
    digits, signs = int((classes == DIGIT).sum()), int((classes == SIGN).sum())
    file = (int(min(3, 40 * digits // visible)), int(min(3, 20 * signs // visible)))
    parts = [_tokens(codes[a:b], classes[a:b], a) for a, b in _pieces(codes, classes, piece)] or [_tokens(codes, classes, 0)]
    start, end, makeup, length, changes, vowels, word = (np.concatenate(c) for c in zip(*parts))
    # What stands before a token: 0 another token, 1 a blank, 2 a line end or the start of the text.
    left = np.append(0, end[:-1]) if len(end) else end
    lines = np.flatnonzero(codes == 10)
    before = np.where(np.searchsorted(lines, start) > np.searchsorted(lines, left), 2, start > left).astype(np.int8)
    before[:1] = 2
    return Tokens(start, end, makeup, length, changes, vowels, before, word, file)


def _tokens(codes: np.ndarray, classes: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
    joined = (classes != BLANK) & (classes != SIGN)
    first = classes != BLANK
    first[1:] &= ~(joined[1:] & joined[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int8, np.int8, np.int8, np.int8, np.uint64))
    last = classes != BLANK
    last[:-1] &= ~(joined[1:] & joined[:-1])
    end = np.flatnonzero(last) + 1
    length = end - start

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[end] - total[start]

    lower, upper, digit, wide, joiner = (count(classes == k) for k in (LOWER, UPPER, DIGIT, WIDE, JOINER))
    letters = lower + upper
    makeup = np.select(
        [
            wide > 0, (joiner > 0) & (length > 1), joiner > 0, digit == length, lower == length,
            (upper == length) & (length > 1), (upper == 1) & (lower == length - 1) & (classes[start] == UPPER),
            letters == length, (upper == 0) & (digit > 0), (lower == 0) & (digit > 0), digit > 0,
        ],
        [M_WIDE, M_JOINED, M_SIGN, M_DIGITS, M_LOWER, M_UPPER, M_CAPITAL, M_MIXED, M_LOWER_DIGIT, M_UPPER_DIGIT, M_MIXED_DIGIT],
        M_SIGN,
    )
    c = codes[start]
    makeup = np.where(makeup == M_SIGN, SIGN_MAKEUPS[np.minimum(c, 127)], makeup)
    # Changes inside a token between letters, digits and the rest, and from a small to a capital letter.
    kind = np.where((classes == LOWER) | (classes == UPPER) | (classes == WIDE), 1, np.where(classes == DIGIT, 2, 0))
    change = np.zeros(len(codes), bool)
    change[1:] = (kind[1:] != kind[:-1]) | ((classes[1:] == UPPER) & (classes[:-1] == LOWER))
    change[start] = False
    changes = np.searchsorted([1, 2, 3, 5, 8], count(change), "right")
    share = count(VOWELS[np.minimum(codes, 0xFFFF)]) * 10 // np.maximum(1, letters)
    vowels = np.where(letters < 6, 0, 1 + np.searchsorted([1, 2, 3, 5], share, "right"))
    # A polynomial hash per token from running sums: the sum of code * base^place, freed of base^start.
    folded = np.where(classes == UPPER, codes + 32, codes).astype(np.uint64)
    powers = _powers(len(codes))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(folded * powers[0][: len(codes)], dtype=np.uint64)])
        word = (total[end] - total[start]) * powers[1][start]
    bucket = np.searchsorted(LENGTHS, length, "right")
    return (
        start + offset, end + offset, makeup.astype(np.int8), bucket.astype(np.int8), changes.astype(np.int8),
        vowels.astype(np.int8), word,
    )


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, as many as any call so far needed."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(HASH_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            made = [np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (HASH_BASE, inverse)]
        _POWERS[:] = made
    return _POWERS


# --- features ---------------------------------------------------------------------


LONG = 7
# Families that hold for every token.
ALWAYS = 4
SHAPES = MAKEUPS * 16 * 8 * 8 * 4


def shape(makeup: np.ndarray, length: np.ndarray, changes: np.ndarray, vowels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number for all a token's shape features."""
    return (((makeup.astype(np.int64) * 16 + length) * 8 + changes) * 8 + vowels) * 4 + before


def shape_families(number: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Feature families of a token's shape: the number of the one feature that holds, and how many there are."""
    number, before = number // 4, number % 4
    number, vowels = number // 8, number % 8
    number, changes = number // 8, number % 8
    makeup, length = number // 16, number % 16
    full = 1 + (length * 8 + changes) * 8 + vowels
    return [
        (makeup * 16 + length, MAKEUPS * 16),
        (makeup * 8 + changes, MAKEUPS * 8),
        (makeup * 8 + vowels, MAKEUPS * 8),
        (makeup * 4 + before, MAKEUPS * 4),
        # Shape in full for tokens long enough to be a secret.
        (np.where(length >= LONG, full, 0), 1 + 16 * 64),
    ]


MIXED = np.isin(np.arange(MAKEUPS), (M_DIGITS, M_UPPER, M_MIXED, M_LOWER_DIGIT, M_UPPER_DIGIT, M_MIXED_DIGIT, M_JOINED))


def capable(makeup: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Shapes that may hold a secret: what stands around them has features of its own."""
    return (MIXED[makeup] & (length >= 4)) | (length >= 9)


def families(t: Tokens, at: np.ndarray, vocabulary: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """All feature families of the tokens numbered `at`; behind the first `ALWAYS`, number 0 is no feature.

    `vocabulary` holds the sorted hashes of the known words.
    """
    n, long, able = len(t.start), t.length[at] >= LONG, capable(t.makeup[at], t.length[at])
    out = shape_families(shape(t.makeup[at], t.length[at], t.changes[at], t.vowels[at], t.before[at]))
    out += [(np.where(long, 1 + share, 0), 5) for share in t.file]
    for k in range(-REACH, REACH + 1):
        there = at + k
        valid = (there >= 0) & (there < n)
        there = there.clip(0, n - 1)
        words = t.word[there]
        place = np.searchsorted(vocabulary, words)
        known = valid & (able | (k == 0))
        known &= vocabulary[np.minimum(place, len(vocabulary) - 1)] == words if len(vocabulary) else False
        out.append((np.where(known, place + 1, 0), len(vocabulary) + 1))
        if 0 < abs(k) <= 2:
            makeup = np.where(valid, t.makeup[there].astype(np.int64), MAKEUPS) * 2 + long
            out.append((np.where(able, 1 + makeup, 0), 1 + 2 * (MAKEUPS + 1)))
    return out


# No sequence with one of these moves or tags counts.
NEVER = -1e6
FORBIDDEN = np.array([[0, 0, NEVER], [0, 0, 0], [0, 0, 0]])
FORBIDDEN_FIRST = np.array([0, 0, NEVER])


def ruled_out(t: Tokens, at: np.ndarray) -> np.ndarray:
    """NEVER for tags a token cannot have: begin by its shape, inside behind a blank."""
    out = np.zeros((len(at), 3))
    out[~capable(t.makeup[at], t.length[at]), BEGIN] = NEVER
    out[t.before[at] != 0, INSIDE] = NEVER
    return out


def gold_tags(t: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of the tokens within the given spans, as far as a sequence may have them."""
    tags, able = np.zeros(len(t.start), np.int64), capable(t.makeup, t.length)
    for a, b in spans:
        inside = np.flatnonzero((t.start >= a) & (t.end <= b))
        first = inside[able[inside]][:1]
        for k in inside[inside >= first[0]] if len(first) else ():
            if k > first[0] and t.before[k]:
                break
            tags[k] = BEGIN if k == first[0] else INSIDE
    return tags


@dataclass(frozen=True)
class Model:
    """Weights by feature and tag (one table for all families), by pair of tags, and of the first tag."""

    vocabulary: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, t: Tokens, at: np.ndarray) -> np.ndarray:
        out, offset = np.zeros((len(at), 3)), 0
        for index, size in families(t, at, self.vocabulary):
            out += self.weights[offset : offset + size][index]
            offset += size
        out[:, OUT] += CAUTION
        return out + ruled_out(t, at)

    def tags(self, t: Tokens) -> np.ndarray:
        """The most likely tags: Viterbi over the stretches of tokens between blanks where a secret can begin."""
        n = len(t.start)
        tags = np.zeros(n, np.int8)
        able = np.flatnonzero(capable(t.makeup, t.length))
        if not len(able):
            return tags
        run = np.cumsum(t.before != 0)
        some = np.zeros(run[-1] + 1, bool)
        some[run[able]] = True
        at = np.flatnonzero(some[run])
        e = self.emissions(t, at)
        # What a begin and each token inside gain over "outside" at most, their moves included.
        moves, m = self.moves, self.moves[[BEGIN, INSIDE]]
        into = max((moves[:, BEGIN] - moves[:, OUT]).max(), self.first[BEGIN] - self.first[OUT])
        begin = e[:, BEGIN] - e[:, OUT] + into + (m[:, :INSIDE] - moves[OUT, :INSIDE]).max()
        inside = e[:, INSIDE] - e[:, OUT] + m[:, INSIDE].max() - moves[OUT, OUT]
        gain = np.maximum(0, np.maximum(begin, inside))
        edges = np.flatnonzero(np.diff(run[at], prepend=-1))
        most = np.maximum.reduceat(begin - gain, edges) + np.add.reduceat(gain, edges)
        keep = np.repeat(most >= -1e-6, np.diff(np.append(edges, len(at))))
        at, e = at[keep], e[keep]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1):
            if len(part):
                a, b = int(at[part[0]]), int(at[part[-1]]) + 1
                first = moves[OUT] if a else self.first
                last = moves[:, OUT] if b < n else np.zeros(3)
                tags[a:b] = viterbi(e[part], first, moves, last)
        return tags

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets by the field: start and end of every begin with what follows inside."""
        t = tokens(text)
        tags = self.tags(t)
        out = []
        for k in np.flatnonzero(tags):
            if tags[k] == BEGIN:
                out.append((int(t.start[k]), int(t.end[k])))
            else:
                out[-1] = (out[-1][0], int(t.end[k]))
        return out

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """All spans of a text: those of the base patterns, and those the field adds."""
        base = base_spans(text)
        more = [("field", a, b) for a, b in self.spans(text) if not _within(a, b, base)]
        return ordered(base + more)


def _within(a: int, b: int, spans: list[tuple[str, int, int]]) -> bool:
    return any(start <= a and b <= end for _, start, end in spans)


def viterbi(e: np.ndarray, first: np.ndarray, moves: np.ndarray, last: np.ndarray) -> list[int]:
    """The best sequence; of equal ones the earlier tag in the order of the tags wins."""
    rows, m = e.tolist(), moves.tolist()
    score = [x + float(f) for x, f in zip(rows[0], first)]
    back = []
    for row in rows[1:]:
        best = [max(range(3), key=lambda p, y=y: (score[p] + m[p][y], -p)) for y in range(3)]
        score = [score[best[y]] + m[best[y]][y] + row[y] for y in range(3)]
        back.append(best)
    tag = max(range(3), key=lambda p: (score[p] + float(last[p]), -p))
    out = [tag]
    for best in reversed(back):
        out.append(best[out[-1]])
    return out[::-1]


# --- training ---------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(windows: list[tuple[str, list[tuple[int, int]]]], vocabulary: int = VOCABULARY) -> Model:
    """Gradient ascent on the likelihood of the tags of labelled windows (text, spans of its secrets)."""
    # Longer windows first: the windows that reach a place are then the first ones.
    windows = sorted(windows, key=lambda w: -len(tokens(w[0]).start))
    made = [tokens(text) for text, _ in windows]
    counts: Counter = Counter()
    for t in made:
        counts.update(set(t.word[t.length < 7].tolist()))
    words = sorted(counts, key=lambda w: (-counts[w], w))[:vocabulary]
    words = np.array(sorted(w for w in words if counts[w] >= 3), np.uint64)
    length = max([len(t.start) for t in made] or [0])
    if not length:
        return Model(words, np.zeros((0, 3)), FORBIDDEN, FORBIDDEN_FIRST)
    n = len(made)
    mask, gold, never = np.zeros((n, length), bool), np.zeros((n, length), np.int64), np.zeros((n, length, 3))
    cells, columns, offset = [], [], 0
    for i, (t, (_, spans)) in enumerate(zip(made, windows)):
        k = len(t.start)
        mask[i, :k] = True
        gold[i, :k] = gold_tags(t, spans)
        never[i, :k] = ruled_out(t, np.arange(k))
        offset = 0
        for number, (index, size) in enumerate(families(t, np.arange(k), words)):
            there = np.flatnonzero(index) if number >= ALWAYS else np.arange(k)
            cells.append(i * length + there)
            columns.append(index[there] + offset)
            offset += size
    flat_cell, flat_column, size = np.concatenate(cells), np.concatenate(columns), offset
    # Only features met in the windows have weights that can move.
    met = np.unique(flat_column)
    flat_column = np.searchsorted(met, flat_column)
    pairs, total, reach = mask[:, 1:], mask.sum(), mask.sum(0)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    onehot = np.eye(3)[gold] * mask[..., None]
    theta = np.zeros(3 * len(met) + 12)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, moves, first = theta[:-12].reshape(3, -1), theta[-12:-3].reshape(3, 3) + FORBIDDEN, theta[-3:] + FORBIDDEN_FIRST
        e = np.zeros((n * length, 3))
        for y in range(3):
            e[:, y] = np.bincount(flat_cell, w[y][flat_column], n * length)
        e = e.reshape(n, length, 3) + never
        forward, backward = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        forward[:, 0] = e[:, 0] + first
        for k in range(1, length):
            m = reach[k]
            forward[:m, k] = _logsum(forward[:m, k - 1, :, None] + moves, 1) + e[:m, k]
            forward[m:, k] = forward[m:, k - 1]
        for k in range(length - 2, -1, -1):
            m = reach[k + 1]
            backward[:m, k] = _logsum(moves + (e[:m, k + 1] + backward[:m, k + 1])[:, None, :], 2)
        z = _logsum(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        joint = forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        joint = np.exp(np.minimum(joint, 0)) * pairs[..., None, None]
        miss = (onehot - p).reshape(-1, 3)
        grad_w = np.stack([np.bincount(flat_column, miss[flat_cell, y], len(met)) for y in range(3)])
        start = miss.reshape(n, length, 3)[:, 0].sum(0)
        grad = np.concatenate([grad_w.ravel(), (gold_moves - joint.sum((0, 1))).ravel(), start]) - RIDGE * theta
        grad /= total
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta = theta + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros((size, 3))
    weights[met] = theta[:-12].reshape(3, -1).T
    return Model(words, weights, theta[-12:-3].reshape(3, 3) + FORBIDDEN, theta[-3:] + FORBIDDEN_FIRST)


# Public forms of credentials, and names under which secrets and other values stand.
SECRET_NAMES = (
    "password passwd pwd pass secret token key apikey api_key access_key secret_key client_secret auth_token "
    "access_token refresh_token credential credentials private_key passphrase auth authorization bearer session_key "
    "db_password AWS_SECRET_ACCESS_KEY API_TOKEN SECRET_KEY DB_PASS"
).split()
OTHER_NAMES = (
    "name title id user version date time path file url host port page line color size width type mode status state "
    "count total price phone order invoice isbn build commit item number ref code"
).split()
PREFIXES = (("ghp_", 36), ("gho_", 36), ("sk_live_", 24), ("pk_live_", 24), ("xoxb-", 24), ("AIza", 35), ("glpat-", 20),
            ("npm_", 36), ("SG.", 22), ("AKIA", 16), ("ASIA", 16), ("sk-", 40))
STOCK = ("The first line tells what happened, and where it did.", "A second one follows with more detail.")
ALNUM, HEXDIGITS, BASE64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"


class Composer:
    """Writes seeded secrets and look-alikes into windows of given texts."""

    def __init__(self, texts: list[str], seed: int = SEED):
        self.rng = random.Random(seed)
        self.texts = [t for t in texts if t.split()] or list(STOCK)
        self.words = sorted({w for t in self.texts[:200] for w in re.findall(r"[^\W\d_]{3,12}", t)}) or ["word", "text"]

    def run(self, alphabet: str, least: int, most: int) -> str:
        return "".join(self.rng.choices(alphabet, k=self.rng.randint(least, most)))

    def value(self) -> str:
        """A secret by itself."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.2:
            return self.run(ALNUM, 16, 44)
        if kind < 0.35:
            return self.run(HEXDIGITS, 16, 64)
        if kind < 0.5:
            return self.run(BASE64, 20, 64) + rng.choice(["", "=", "=="])
        if kind < 0.75:
            prefix, n = rng.choice(PREFIXES)
            return prefix + (self.run(string.ascii_uppercase + string.digits, n, n) if prefix.isupper() else self.run(ALNUM, n, n))
        if kind < 0.85:
            return "eyJ" + self.run(ALNUM + "_", 16, 30) + "." + "eyJ" + self.run(ALNUM + "_", 20, 60) + "." + self.run(ALNUM + "_-", 22, 43)
        return self.run(string.ascii_uppercase + string.digits, 16, 32)

    def password(self) -> str:
        return "".join(self.rng.choices(ALNUM + "!@#$%^*?_", k=self.rng.randint(8, 18)))

    def placed(self, value: str, names: list[str]) -> tuple[str, int]:
        """A value as an assignment, and where it starts."""
        rng, name = self.rng, self.rng.choice(names)
        name = rng.choice([name, name, name.upper(), name.title(), name.replace("_", "-")])
        form = rng.choice(['{n} = "{v}"', "{n}={v}", "{n}: {v}", '"{n}": "{v}"', "{n} = '{v}'", "export {n}={v}", "--{n} {v}", "{n}:{v}", "my_{n} := {v};"])
        head = form.split("{v}")[0].format(n=name)
        return form.format(n=name, v=value), len(head)

    def secret(self) -> tuple[str, int, int]:
        """A snippet with a secret: text, start and end."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.25:
            value = self.value()
            return value, 0, len(value)
        if kind < 0.35:
            value = self.value()
            head = rng.choice(["Authorization: Bearer ", "Bearer ", "Authorization: Basic ", "X-Api-Key: "])
            return head + value, len(head), len(head) + len(value)
        if kind < 0.42:
            value, head = self.run(ALNUM, 10, 24), f"https://{rng.choice(self.words).lower()}:"
            return f"{head}{value}@host.example/path", len(head), len(head) + len(value)
        value = self.password() if rng.random() < 0.25 else self.value()
        text, at = self.placed(value, SECRET_NAMES)
        return text, at, at + len(value)

    def harmless(self) -> str:
        """A snippet that looks like one, without a secret."""
        rng, kind = self.rng, self.rng.random()
        word = lambda: rng.choice(self.words)
        digits = lambda a, b: self.run(string.digits, a, b)
        if kind < 0.2:
            plain = rng.choice([word(), word().lower(), "null", "None", "required", "******", "<your-password>", "changeme", f"{word()} {word()}", "true", "your_token_here"])
            return self.placed(plain, SECRET_NAMES)[0]
        if kind < 0.3:
            return f"the {rng.choice(['token', 'secret', 'password', 'key', 'api key'])} {rng.choice(['of', 'was', 'is', 'for', 'and'])} {word()}"
        if kind < 0.5:
            plain = rng.choice([
                digits(8, 20), digits(4, 4) + " " + digits(4, 4) + " " + digits(4, 4) + " " + digits(4, 4), f"+{digits(2, 2)} {digits(3, 3)} {digits(4, 7)}",
                f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)}:{digits(2, 2)}:{digits(2, 2)}Z", f"{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}",
                f"{digits(3, 3)}-{digits(2, 2)}-{digits(4, 4)}", f"{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}", f"#{self.run(HEXDIGITS, 6, 6)}",
                f"{digits(1, 3)},{digits(3, 3)},{digits(3, 3)}", f"[{digits(1, 3)}]", f"§ {digits(1, 3)}",
            ])
            return rng.choice([plain, plain, self.placed(plain, OTHER_NAMES)[0]])
        if kind < 0.65:
            return rng.choice([
                f"https://www.{word().lower()}.example/{word().lower()}/{word().lower()}-{digits(1, 5)}?{rng.choice(OTHER_NAMES)}={digits(1, 6)}#top",
                f"{word().lower()}.{word().lower()}{digits(0, 3)}@example.org", f"/usr/{word().lower()}/{word().lower()}_{digits(1, 3)}/{word().lower()}.txt",
                f"C:\\{word()}\\{word()}", f"{word().lower()}/{word().lower()}/{word().lower()}",
            ])
        if kind < 0.8:
            return rng.choice([
                word().lower() + word().title() + word().title(), "_".join(word().lower() for _ in range(3)), word().lower() * 3, word().upper() + word().upper(),
                "-".join(word().lower() for _ in range(4)), f"{word()}{digits(1, 4)}", f"{word().lower()}_{digits(1, 2)}", "=" * rng.randint(3, 20), "".join(word().lower() for _ in range(4)),
                "".join(word().lower() for _ in range(5))[:24] + rng.choice(["$$$", "###", "&&&", "***", "%%%", "!!!", "..."]),
                "_".join(word().upper() for _ in range(3)), word().title() + word().title() + word().title() + "Error",
            ])
        return self.placed(rng.choice([word(), digits(1, 8), f"{digits(1, 2)}.{digits(1, 2)}", word().lower() + digits(1, 3)]), OTHER_NAMES)[0]

    def window(self, width: int) -> str:
        """Some words of a text, as they stand there."""
        text = self.rng.choice(self.texts)
        places = [m.start() for m in re.finditer(r"\S+", text)]
        k = self.rng.randrange(len(places))
        last = min(len(places) - 1, k + self.rng.randint(1, width))
        return text[places[k] : places[last]].strip() or text[places[k] : places[k] + 200]

    def labelled(self, windows: int, width: int = WINDOW) -> list[tuple[str, list[tuple[int, int]]]]:
        """Windows with the spans of their secrets: what base patterns find and what was written in."""
        out = []
        for _ in range(windows):
            left, right = self.window(width // 2), self.window(width // 4)
            join = self.rng.choice([" ", " ", "\n", "\n  ", ' "', " ("])
            kind = self.rng.random()
            if kind < 0.35:
                snippet, a, b = self.secret()
                spans = [(len(left) + len(join) + a, len(left) + len(join) + b)]
            elif kind < 0.8:
                snippet, spans = self.harmless(), []
            else:
                snippet, spans = self.window(width // 4), []
            text = f"{left}{join}{snippet}{self.rng.choice([' ', chr(10), '. ', ', '])}{right}"
            out.append((text, _values(text, spans)))
        return out


def _values(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The given spans, and the secrets within base spans that meet none of them."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8 and re.search(r"\d", m[2])]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16] + [m.span() for m in HEX.finditer(text)]
    out = list(spans)
    for a, b in sorted(found):
        if all(b <= s or e <= a for s, e in out):
            out.append((a, b))
    return sorted(out)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = MOST_DOCS, windows: int = WINDOWS,
    excerpt: int = 4_000,
) -> Model:
    """Fit on windows of at most `most_docs` documents; `excerpt` characters from the middle of each are enough
    to draw windows from, and bound what reaches the driver. Scanning has no such bound."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    picked = docs.select(F.xxhash64("id").alias("h"), F.col("id").alias("picked_id")).distinct()
    picked = picked.orderBy("h", "picked_id").limit(most_docs)
    middle = F.greatest(F.lit(1), (F.length("text") - excerpt) / 2).cast("int")
    # At most `most_docs` ids: small enough to send to every task.
    rows = docs.join(F.broadcast(picked), F.col("id") == F.col("picked_id")).select("h", F.substring(F.col("text"), middle, F.lit(excerpt)).alias("t"))
    texts = sorted((r["h"], r["t"]) for r in rows.groupBy("h").agg(F.max("t").alias("t")).collect())
    return fit(Composer([t for _, t in texts]).labelled(windows))


def scanned(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in model.scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
