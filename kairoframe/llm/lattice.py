"""Forward recursion over all segmentations of words into pieces of a fixed public vocabulary.

The text of a word is a marker, U+2581, and its characters. A segmentation covers it with pieces; its
probability is the product of the pieces' probabilities, and the word's is the sum over segmentations.
With a[0] = 0, in log space,

    a[j] = log sum over l of exp(a[j - l] + log p(piece that ends at j with length l))

A character that is no piece is spelt by the vocabulary's byte pieces, so every word has a probability.
Words of equal length are done together, as arrays; a very long word is done alone, position by position.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

MARK = "▁"
#: Words of more characters go alone; (words x positions) of a group at once.
LONG, GROUP = 64, 200_000
_B = np.uint64(0x9E3779B97F4A7C15)
_TAG_BITS = 18


class Pieces:
    """The pieces of a sentencepiece model: strings, hashes for search, and the ids of its byte pieces."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        strings: dict[str, int] = {}
        for i in range(self.size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                strings.setdefault(sp.id_to_piece(i), i)
        self.ids = strings
        self.longest = max(map(len, strings))
        by_length: dict[int, list[str]] = defaultdict(list)
        for s in strings:
            by_length[len(s)].append(s)
        keys, ids = [], []
        for n, group in by_length.items():
            chars = _chars(group, n)
            h = np.zeros(len(group), np.uint64)
            for k in range(n):
                h = _roll(h, chars[:, k])
            keys.append(h)
            ids.append(np.array([strings[s] for s in group], np.int64))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.tags = np.zeros(1 << _TAG_BITS, bool)
        self.tags[self.keys >> np.uint64(64 - _TAG_BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are hashes of pieces, and the pieces' ids."""
        at = np.nonzero(self.tags[h >> np.uint64(64 - _TAG_BITS)])[0]
        some = h[at]
        k = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[k] == some
        return at[hit], self.key_ids[k[hit]]

    def spelt(self, char: str) -> list[int]:
        """Byte pieces of one character."""
        return [int(self.bytes[b]) for b in char.encode("utf-8", "surrogatepass")]

    def initial(self) -> np.ndarray:
        """Probabilities before any training: the vocabulary's order by merge score, as Zipf's law."""
        weight = 1.0 / (np.arange(self.size) + 100.0)
        weight[self.bytes] = 1e-6
        return np.log(weight / weight.sum())


def _chars(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (h ^ c.astype(np.uint64)) * _B
    return x ^ (x >> np.uint64(29))


def _byte_logp(pieces: Pieces, logp: np.ndarray, cache: dict, code: int) -> np.ndarray:
    if code not in cache:
        cache[code] = sum(logp[i] for i in pieces.spelt(chr(code)))
    return cache[code]


def _groups(words: list[str]) -> dict[int, list[int]]:
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + 1].append(i)
    return by_length


def log_likelihood(pieces: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, models) natural log probabilities; logp is (pieces, models)."""
    out = np.zeros((len(words), logp.shape[1]))
    spelt: dict[int, np.ndarray] = {}
    for n, members in _groups(words).items():
        if n > LONG:
            for i in members:
                out[i] = _alone(pieces, logp, spelt, MARK + words[i])
            continue
        step = max(1, GROUP // n)
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            out[part] = _together(pieces, logp, spelt, [MARK + words[i] for i in part], n)[n]
    return out


def _edges(pieces: Pieces, chars: np.ndarray, n: int):
    """(start, length, rows, ids) for each start and length, rows being the words that have a piece there."""
    for i in range(n):
        h = np.zeros(len(chars), np.uint64)
        for length in range(1, min(pieces.longest, n - i) + 1):
            h = _roll(h, chars[:, i + length - 1])
            rows, ids = pieces.find(h)
            yield i, length, rows, ids


def _together(pieces: Pieces, logp: np.ndarray, spelt: dict, words: list[str], n: int) -> list[np.ndarray]:
    """The forward arrays a[0..n], each (words, models)."""
    chars, m = _chars(words, n), logp.shape[1]
    a = [np.full((len(words), m), -np.inf) for _ in range(n + 1)]
    a[0][:] = 0.0
    for i, length, rows, ids in _edges(pieces, chars, n):
        if length == 1 and len(rows) < len(words):
            rest = np.ones(len(words), bool)
            rest[rows] = False
            rest = np.nonzero(rest)[0]
            codes, back = np.unique(chars[rest, i], return_inverse=True)
            value = np.stack([_byte_logp(pieces, logp, spelt, int(c)) for c in codes])
            a[i + 1][rest] = np.logaddexp(a[i + 1][rest], a[i][rest] + value[back])
        if len(rows):
            a[i + length][rows] = np.logaddexp(a[i + length][rows], a[i][rows] + logp[ids])
    return a


def _hits(pieces: Pieces, codes: np.ndarray):
    """(length, starts, ids) of the pieces in one word."""
    n = len(codes)
    h = np.zeros(n, np.uint64)
    for length in range(1, min(pieces.longest, n) + 1):
        h = _roll(h[: n - length + 1], codes[length - 1 :])
        yield length, *pieces.find(h)


def _alone(pieces: Pieces, logp: np.ndarray, spelt: dict, word: str) -> np.ndarray:
    n, m = len(word), logp.shape[1]
    codes = _chars([word], n)[0]
    found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    single = np.zeros(n, bool)
    for length, at, ids in _hits(pieces, codes):
        if length == 1:
            single[at] = True
        for i, p in zip(at.tolist(), ids.tolist(), strict=True):
            found[i + length].append((i, p))
    a = np.full((n + 1, m), -np.inf)
    a[0] = 0.0
    for j in range(1, n + 1):
        terms = [a[i] + logp[p] for i, p in found[j]]
        if not single[j - 1]:
            terms.append(a[j - 1] + _byte_logp(pieces, logp, spelt, int(codes[j - 1])))
        a[j] = np.logaddexp.reduce(terms, axis=0) if len(terms) > 1 else terms[0]
    return a[n]


def _log_add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x))


def _count_alone(pieces: Pieces, logp: np.ndarray, word: str, weight: float, counts: np.ndarray) -> None:
    """Adds one word's expected uses to counts."""
    n = len(word)
    codes = _chars([word], n)[0]
    hits = list(_hits(pieces, codes))
    single = np.zeros(n, bool)
    single[hits[0][1]] = True
    rest = np.nonzero(~single)[0]
    spelt, back = np.unique(codes[rest], return_inverse=True)
    value = np.array([sum(logp[p] for p in pieces.spelt(chr(c))) for c in spelt])
    ids = np.concatenate([h[2] for h in hits])
    start = np.concatenate([*(h[1] for h in hits), rest])
    end = np.concatenate([*(h[1] + h[0] for h in hits), rest + 1])
    edge = np.concatenate([logp[ids], value[back]])
    order = np.argsort(start, kind="stable")
    edges = list(zip(start[order].tolist(), end[order].tolist(), edge[order].tolist(), strict=True))
    a, b = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    a[0] = b[n] = 0.0
    for i, j, x in edges:
        a[j] = _log_add(a[i] + x, a[j])
    for i, j, x in reversed(edges):
        b[i] = _log_add(x + b[j], b[i])
    share = np.exp(np.array(a)[start] + edge + np.array(b)[end] - a[n]) * weight
    counts += np.bincount(ids, share[: len(ids)], pieces.size)
    for c, total in zip(spelt, np.bincount(back, share[len(ids) :], len(spelt)), strict=True):
        for p in pieces.spelt(chr(c)):
            counts[p] += total


def expected_counts(pieces: Pieces, logp: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations (one model); weights: counts of the words."""
    counts = np.zeros(pieces.size)
    one = logp.reshape(-1, 1)
    for n, members in _groups(words).items():
        if n > LONG:
            for i in members:
                _count_alone(pieces, logp, MARK + words[i], weights[i], counts)
            continue
        step = max(1, GROUP // n)
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            texts, w = [MARK + words[i] for i in part], weights[part]
            a = np.stack([x[:, 0] for x in _together(pieces, one, {}, texts, n)])
            chars = _chars(texts, n)
            edges = list(_edges(pieces, chars, n))
            b = np.full((n + 1, len(part)), -np.inf)
            b[n] = 0.0
            for i, length, rows, ids in reversed(edges):
                if length == 1 and len(rows) < len(part):
                    rest = np.ones(len(part), bool)
                    rest[rows] = False
                    rest = np.nonzero(rest)[0]
                    codes, back = np.unique(chars[rest, i], return_inverse=True)
                    value = np.array([sum(logp[p] for p in pieces.spelt(chr(c))) for c in codes])
                    b[i][rest] = np.logaddexp(b[i][rest], b[i + 1][rest] + value[back])
                    share = np.exp(a[i][rest] + value[back] + b[i + 1][rest] - a[n][rest]) * w[rest]
                    for c, total in zip(codes, np.bincount(back, share, len(codes)), strict=True):
                        for p in pieces.spelt(chr(c)):
                            counts[p] += total
                if len(rows):
                    b[i][rows] = np.logaddexp(b[i][rows], b[i + length][rows] + logp[ids])
                    share = np.exp(a[i][rows] + logp[ids] + b[i + length][rows] - a[n][rows]) * w[rows]
                    counts += np.bincount(ids, share, pieces.size)
    return counts


def reestimated(counts: np.ndarray, smoothing: float = 0.1) -> np.ndarray:
    """Log probabilities from expected counts."""
    total = counts + smoothing
    return np.log(total / total.sum())


def brute_force(pieces: Pieces, logp: np.ndarray, word: str) -> float:
    """The same sum by listing segmentations; for tests of short words."""
    text = MARK + word

    def rest(i: int) -> float:
        if i == len(text):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in pieces.ids:
                total += math.exp(logp[pieces.ids[text[i:j]]]) * rest(j)
        if text[i] not in pieces.ids:
            total += math.exp(sum(logp[p] for p in pieces.spelt(text[i]))) * rest(i + 1)
        return total

    return math.log(rest(0))
