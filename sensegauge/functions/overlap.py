"""Overlap metrics of two word lists, in plain Python; operators.metrics runs them on Arrow batches.

All are on a scale of 0 to 100 and follow the published definitions; choices that these leave open are stated.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np

Words = Sequence[str]


class Text(list):
    """Words that remember their n-grams, for several metrics of one pair."""

    def __init__(self, words: Words) -> None:
        super().__init__(words)
        self.grams: dict[int, Counter] = {}


def grams(words: Words, n: int) -> Counter:
    known = words.grams if isinstance(words, Text) else {}
    if n not in known:
        known[n] = Counter(zip(*(words[i:] for i in range(n)), strict=False))
    return known[n]


def matches(a: Counter, b: Counter) -> int:
    """Clipped matches of two tables of n-grams."""
    return sum(min(a[g], b[g]) for g in a.keys() & b.keys())


def f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_n(original: Words, simplification: Words, n: int) -> float:
    """F of clipped n-gram overlap (Lin 2004); 0 where either has no n-gram."""
    a, b = grams(original, n), grams(simplification, n)
    if not a or not b:
        return 0.0
    both = matches(a, b)
    return 100 * f1(both / b.total(), both / a.total())


def lcs(a: Words, b: Words) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits (Hyyro 2004)."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l(original: Words, simplification: Words) -> float:
    """F of the longest common subsequence."""
    if not original or not simplification:
        return 0.0
    n = lcs(original, simplification)
    return 100 * f1(n / len(simplification), n / len(original))


def bleu(reference: Words, prediction: Words, orders: int = 4) -> float:
    """BLEU of one pair (Papineni 2002): brevity penalty times the geometric mean of clipped n-gram precisions.

    Open choices: orders above the prediction's length are left out; an order without a match counts as 1 / 2^k of a
    match, k being the number of such orders so far; no words or no common word give 0.
    """
    if not prediction or not reference:
        return 0.0
    logs, halves = [], 1.0
    for n in range(1, min(orders, len(prediction)) + 1):
        a, b = grams(reference, n), grams(prediction, n)
        both, total = matches(a, b), b.total()
        if both == 0:
            if n == 1:
                return 0.0
            halves *= 2
            logs.append(-math.log(halves * total))
        else:
            logs.append(math.log(both / total))
    penalty = min(0.0, 1 - len(reference) / len(prediction))
    return 100 * math.exp(penalty + sum(logs) / len(logs))


def sari(source: Words, prediction: Words, references: Sequence[Words], orders: int = 4) -> float:
    """SARI (Xu et al. 2016): mean over n = 1..4 of keep F, deletion precision and addition F, with 0/0 as 1."""
    refs = len(references)
    ratio = lambda a, n: a / n if n else 1.0
    total = 0.0
    for n in range(1, orders + 1):
        s, c = grams(source, n), grams(prediction, n)
        r = sum((grams(x, n) for x in references), Counter())
        s_all, c_all = Counter({g: k * refs for g, k in s.items()}), Counter({g: k * refs for g, k in c.items()})
        keep, all_keep = s_all & c_all, s_all & r
        good = keep & r
        keep_p = ratio(sum(good[g] / keep[g] for g in good), len(keep))
        keep_r = ratio(sum(good[g] / all_keep[g] for g in good), len(all_keep))
        gone = s_all - c_all
        del_p = ratio(sum((gone - r)[g] / gone[g] for g in gone - r), len(gone))
        added, wanted = set(c) - set(s), set(r) - set(s)
        hit = len(added & wanted)
        total += f1(keep_p, keep_r) + del_p + f1(ratio(hit, len(added)), ratio(hit, len(wanted)))
    return 100 * total / (3 * orders)


def sari_own(source: Words, prediction: Words, orders: int = 4) -> float:
    """``sari`` of a source that is its own only reference: all of it is wanted, so what is kept counts in full, and nothing
    should be deleted or added."""
    if source == prediction:
        return 100.0
    total = 0.0
    for n in range(1, orders + 1):
        s, c = grams(source, n), grams(prediction, n)
        kept = sum(min(k, c[g]) / k for g, k in s.items() if g in c)
        keep_r = kept / len(s) if s else 1.0
        total += f1(1.0, keep_r) + (not any(k > c.get(g, 0) for g, k in s.items())) + (c.keys() <= s.keys())
    return 100 * total / (3 * orders)


def meteor_exact(reference: Words, prediction: Words) -> float:
    """METEOR (Banerjee and Lavie 2005) with exact matches only: F with recall weighing 9, less 0.5 * (chunks / matches)^3.

    Words are matched from the left, each to the next free place after the last match where there is one, which keeps
    chunks few.
    """
    free: dict[str, list[int]] = {}
    for i, w in enumerate(reference):
        free.setdefault(w, []).append(i)
    at, matched = -1, []
    for j, w in enumerate(prediction):
        places = free.get(w)
        if places:
            i = next((p for p in places if p > at), places[0])
            places.remove(i)
            matched.append((j, i))
            at = i
    m = len(matched)
    if not m:
        return 0.0
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matched, matched[1:]))
    p, r = m / len(prediction), m / len(reference)
    return 100 * (10 * p * r / (r + 9 * p)) * (1 - 0.5 * (chunks / m) ** 3)


def _distance(a: Words, b: Words) -> int:
    """Edits between word lists, with the columns of the table as bits (Myers 1999)."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for w in b:
        eq = places.get(w, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        right_up = (down | ~(d0 | up)) & full
        right_down = up & d0
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = (right_up << 1 | 1) & full
        up = (right_down << 1 & full | ~(d0 | right_up)) & full
        down = right_up & d0
    return score


#: Texts that are compared at once, first and later on, and words of these together.
FIRST, TOGETHER, TOGETHER_WORDS = 16, 128, 1 << 17


def _distances(texts: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Edits between each row of texts, numbers of words, and one list of ``size`` words, as ``_distance``. The columns of
    all rows' tables stand side by side in one number, with a bit that is always 0 in between. places: by number of a word the
    bits of its places in the list, in bytes."""
    rows, steps = texts.shape
    wide = places.shape[1]
    ones = int.from_bytes((b"\1" + bytes(wide - 1)) * rows, "little")
    full = int.from_bytes(((1 << size) - 1).to_bytes(wide, "little") * rows, "little")
    up, down, row = full, 0, rows * wide
    some = max(1, (1 << 20) // row)
    for first in range(0, steps, some):
        bits = places[texts[:, first : first + some].T].tobytes()
        for at in range(0, len(bits), row):
            eq = int.from_bytes(bits[at : at + row], "little")
            d0 = ((((eq & up) + up) ^ up) | eq | down) & full
            right_up = ((down | full ^ (d0 | up)) << 1 | ones) & full
            right_down = (up & d0) << 1 & full
            up = right_down | full ^ (d0 | right_up)
            down = right_up & d0
    plus, minus = (np.bitwise_count(np.frombuffer(x.to_bytes(row, "little"), np.uint8).reshape(rows, wide)).sum(1, dtype=np.int64) for x in (up, down))
    return steps + plus - minus


def _moved(hyp: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """A row for each shift (i, j, n): hyp without its n words from i on, these put in before word j of what is left."""
    i, j, n = shifts.T[:, :, None]
    at = np.arange(len(hyp))
    j = np.minimum(j, len(hyp) - n)
    inside = (at >= j) & (at < j + n)
    rest = np.where(at < j, at, at - n)
    return hyp[np.where(inside, i + at - j, rest + n * (rest >= i))]


def _shifts(hyp: list[int], reference: list[int], places: list[list[int]], far: float, longest: float) -> Iterator[tuple[int, int, int]]:
    """i, j, n: the n words of hyp from i on are those of the reference from j on."""
    size, length = len(hyp), len(reference)
    right = [i < length and w == reference[i] for i, w in enumerate(hyp)] + [False] * length
    for i, w in enumerate(hyp):
        for j in places[w]:
            if i == j or right[j] or abs(i - j) > far:
                continue
            n = 0
            while n < longest and i + n < size and j + n < length and hyp[i + n] == reference[j + n]:
                n += 1
            yield i, j, n


#: Fixed values of the published tool: longest shifted phrase, how far it moves, shifts tried in a round.
SHIFT_WORDS, SHIFT_FAR, SHIFTS_TRIED = 10, 50, 1000


def ter(reference: Words, prediction: Words, shift_words: int | None = SHIFT_WORDS, shift_far: int | None = SHIFT_FAR, shifts_tried: int | None = SHIFTS_TRIED) -> float:
    """TER (Snover et al. 2006): edits and phrase shifts for a word of the reference, in percent. Shifts are greedy: the
    one that saves most edits, while one saves any. Without reference words it is 0 for no prediction and 100 else. The
    published tool's three limits are the defaults; None is no limit.

    A shift of n words saves 2 n edits at most, and none leaves fewer edits than the words that have no partner at all;
    shifts that cannot be better than the best one so far are not measured, the others TOGETHER at once."""
    if not reference:
        return 100.0 if prediction else 0.0
    if prediction == reference:
        return 0.0
    far, longest = (math.inf if x is None else x for x in (shift_far, shift_words))
    best, shifts = _distance(prediction, reference), 0
    least = max(len(prediction), len(reference)) - (Counter(prediction) & Counter(reference)).total()
    if best <= least:
        return 100 * best / len(reference)
    number = {w: k for k, w in enumerate(dict.fromkeys(reference))}  # all words that the reference has not are the next number
    hyp, ref = [number.get(w, len(number)) for w in prediction], [number[w] for w in reference]
    places: list[list[int]] = [[] for _ in range(len(number) + 1)]
    for i, w in enumerate(ref):
        places[w].append(i)
    wide = len(ref) // 8 + 1
    bits = np.frombuffer(b"".join(sum(1 << i for i in x).to_bytes(wide, "little") for x in places), np.uint8).reshape(-1, wide)
    while best > least:
        found, key = None, (0, math.inf, 0)
        tried = islice(_shifts(hyp, ref, places, far, longest), None if shifts_tried is None else max(1, shifts_tried))
        # (most that it can save, words, -place), the best first, equal ones in their order
        by = sorted(((min(2 * n, best - least), n, -i, j) for i, j, n in tried), key=lambda x: x[:3], reverse=True)
        words, at = np.array(hyp), 0
        while at < len(by):
            many = max(1, min(TOGETHER if at else FIRST, TOGETHER_WORDS // len(hyp)))
            part = [x for x in by[at : at + many] if x[:3] > key]
            at += many
            if not part:
                break
            moved = _moved(words, np.array([(-i, j, n) for _, n, i, j in part]))
            for (_, n, i, _), saved, row in zip(part, (best - _distances(moved, bits, len(ref))).tolist(), moved, strict=True):
                if saved > 0 and (saved, n, i) > key:
                    found, key = row, (saved, n, i)
        if found is None:
            break
        hyp, shifts, best = found.tolist(), shifts + 1, best - key[0]
    return 100 * (best + shifts) / len(reference)
