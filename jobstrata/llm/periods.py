"""Runs of words that repeat with a period, by Kolpakov and Kucherov's method.

A run is a stretch of words with smallest period q, of at least ``MIN_WORDS``
words and ``TIMES`` periods, which no word beside it extends.  In each stretch
of a text that may hold one:

1. a suffix automaton of the words gives the Lempel-Ziv factorisation: each
   factor is the longest stretch that also starts earlier (or one new word);
2. Main's algorithm finds, at each border of factors, the runs that hold or
   touch the border and end within the next factor: common prefixes and
   suffixes of both sides for every period, from Z functions;
3. all other runs lie strictly inside a factor and are copied from where the
   factor occurred before.

Which stretches may hold a run is decided beforehand, for a whole slab in
numpy and without loss: every ``GRAM`` words in a row of a run occur in it
again, so stretches of at least ``MIN_WORDS - GRAM + 1`` grams that all occur
twice in their own stretch are kept, again and again, until nothing changes.
Equal hashes of different grams only keep more.

Words are compared as numbers that a dict of the stretch gives them, so
results don't depend on hashes.  Memory grows with the longest such stretch of
one text (some 600 bytes a word), never with the table.

Defined results: a null text counts as empty; an empty text, or one without
words, has no run, four nulls and the digests of nothing; repeated rows have
equal results; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NOT_SPACE, doc_rows, map_slabs, mix, runs, span_hash, table

MIN_WORDS, TIMES, GRAM = 24, 3, 4
#: Rounds of the sieve; more would only make it finer.
ROUNDS = 16

# --- the method on one stretch of numbers ----------------------------------------


def factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, earlier start; -1 for a new symbol).

    An earlier occurrence may overlap its factor.
    """
    step, link, size, end = [{}], [-1], [0], [-1]  # a state's first occurrence ends at end[state]
    last = 0
    for i, c in enumerate(w):
        state = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                link[q] = link[state] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        last = state
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            after = step[state][w[j]]
            if end[after] >= j:
                break
            state, j = after, j + 1
        if j == i:
            out.append((i, 1, -1))
            i += 1
        else:
            out.append((i, j - i, end[state] - (j - i) + 1))
            i = j
    return out


def z_function(s: Sequence[int]) -> list[int]:
    """For each place the length of the longest common prefix with the whole."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: list[int], lo: int, border: int, hi: int, most: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """Main's step: (start, end, period) of repetitions with a period of at most
    ``most`` that hold or touch ``border`` and lie in w[lo:hi], where no longer
    one of the same period fits."""
    left, right = w[lo:border], w[border:hi]
    a, b = len(left), len(right)
    back, both = left[::-1], left + right
    # common prefixes with the right side of what starts at border + d, at place a + d + (b + 1)
    ahead = z_function([*right, -2, *both])
    # common suffixes with the left side of what ends at border - d, at place b + d + (a + 1)
    behind = z_function([*back, -2, *both[::-1]])
    out = []
    for q in range(1, min(most, b) + 1):  # the period after the border
        more = ahead[b + 1 + a + q] if q < b else 0
        less = behind[a + 1 + b - q]
        if less + q + more >= max(least, times * q):
            out.append((border - less, border + q + more, q))
    for q in range(1, min(most, a) + 1):  # the period before the border
        more = ahead[b + 1 + a - q]
        less = behind[a + 1 + b + q] if q < a else 0
        if less + q + more >= max(least, times * q):
            out.append((border - q - less, border + more, q))
    return out


def all_runs(w: Sequence[int], least: int = MIN_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs (start, length, smallest period) of a sequence of numbers from 0, by start and period.

    ``times`` is 2 at least.
    """
    n = len(w)
    w = [*w, -1]  # a symbol of its own, so that the last run meets a border
    found: dict[tuple[int, int], int] = {}
    ordered: list[tuple[int, int, int]] = []  # by start

    def add(start: int, end: int, period: int) -> None:
        known = found.get((start, end))
        if known is None or period < known:
            if known is None:
                insort(ordered, (start, end, period))
            else:
                ordered[bisect_left(ordered, (start, end, known))] = (start, end, period)
            found[start, end] = period

    before = 0
    for border, size, source in factors(w):
        # a run that ends in this factor and starts before it has less than one period before the
        # last factor: times * q <= before + q + size
        most = (before + size) // (times - 1)
        hi = border + size
        if border and before + most + size >= least:
            lo = max(0, border - before - most - 1)
            for start, end, q in crossing(w, lo, border, hi, most, least, times):
                if end < n + 1 and not (start > 0 and w[start - 1] == w[start - 1 + q]) and w[end] != w[end - q]:
                    add(start, end, q)
        if source >= 0 and size >= least + 2:
            shift = border - source
            at = bisect_left(ordered, (source + 1, 0, 0))
            while at < len(ordered) and ordered[at][0] < source + size:
                start, end, q = ordered[at]
                if end < source + size:
                    add(start + shift, end + shift, q)
                at += 1
        before = size
    return [(s, e - s, q) for s, e, q in sorted(ordered, key=lambda r: (r[0], r[2]))]


# --- which stretches may hold one ----------------------------------------------------


def stretches(words: np.ndarray, text: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that may hold a run.

    words: hash of each word; text: the text each one belongs to, ascending.
    """
    n = len(words) - GRAM + 1
    if n <= 0:
        return []
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram = mix(gram * np.uint64(31) + words[k : k + n])
    at = np.flatnonzero(text[:n] == text[GRAM - 1 :])  # grams within one text
    part = text[at].astype(np.int64)
    need = least - GRAM + 1
    for _ in range(ROUNDS):
        if not len(at):
            return []
        with np.errstate(over="ignore"):
            key = mix(gram[at] ^ mix(part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if again.all():
            break
        at, part = at[again], part[again]
        if not len(at):
            return []
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
        keep = np.bincount(part)[part] >= need
        at, part = at[keep], part[keep]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return [(s, e + GRAM) for s, e in zip(at[first].tolist(), at[last].tolist(), strict=True) if e - s + 1 >= need]


def numbered(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(x, len(known)) for x in words]


# --- the operator --------------------------------------------------------------------

#: Which word of a text stands at each place: (doc_id, number of words) -> places, or None for as they are.
Order = Callable[[int | None, int], np.ndarray | None]


def text_runs(slab, order: Order | None = None, least: int = MIN_WORDS, times: int = TIMES):
    """For each text of a slab its words and runs."""
    starts, ends, first = runs(NOT_SPACE[slab.data], slab.offs)
    hashes = span_hash(slab.data, starts, ends)
    text = np.repeat(np.arange(len(slab)), np.diff(first))
    moved: dict[int, np.ndarray] = {}
    if order is not None:
        for i, doc in enumerate(slab.ids):
            places = order(doc, int(first[i + 1] - first[i]))
            if places is not None:
                moved[i] = places
                hashes[first[i] : first[i + 1]] = hashes[first[i] : first[i + 1]][places]
    by_text: dict[int, list[tuple[int, int]]] = {}
    for s, e in stretches(hashes, text, least):
        by_text.setdefault(int(text[s]), []).append((s, e))
    for i in range(len(slab)):
        words = bytes(slab.raw(i)).split()  # the six ASCII white-space bytes
        if i in moved:
            words = [words[k] for k in moved[i].tolist()]
        found = []
        for s, e in by_text.get(i, ()):
            s, e = s - int(first[i]), e - int(first[i])
            found += [(s + a, length, q) for a, length, q in all_runs(numbered(words[s:e]), least, times)]
        found.sort(key=lambda r: (r[0], r[2]))
        yield words, found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the most periods; of equal ones the first, then the shortest period."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


RUNS = "doc_id long, start long, length long, period long"


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each run of each text."""

    def run(slab) -> dict:
        rows = [(doc, *r) for doc, (_, found) in zip(slab.ids, text_runs(slab, None, least, times), strict=True) for r in found]
        return {c: [r[k] for r in rows] for k, c in enumerate(("doc_id", "start", "length", "period"))}

    return map_slabs(doc_rows(docs, id_col, text_col), run, RUNS)


def without_runs(docs: DataFrame, least: int = MIN_WORDS, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the words of each text, joined by blanks, without those a run repeats."""

    def run(slab) -> dict:
        return {"doc_id": slab.ids, "text": [b" ".join(collapsed(w, found)).decode() for w, found in text_runs(slab, None, least, times)]}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, text string")


SUMMARY = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def summaries(docs: DataFrame, order: Order | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text the number of runs, the strongest one, and digests of all runs and of the collapsed words."""

    def run(slab) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for words, found in text_runs(slab, order):
            best = strongest(found)
            row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
            text = b" ".join(collapsed(words, found))
            for c, v in zip(out, (len(found), *row, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()), strict=True):
                out[c].append(v)
        return {"doc_id": pa.array(slab.ids, pa.int64())} | out

    return map_slabs(doc_rows(docs, id_col, text_col), run, SUMMARY)


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The query's rule: every tenth text, by the hash of its id, repeats a part of itself up to its end."""
    if doc is None or not n:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op12_periods(spark, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "documents"), planted)
