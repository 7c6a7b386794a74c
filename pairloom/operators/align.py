"""Local alignment with affine gaps, vectorised over the pairs of an Arrow batch.

A gap of n letters costs gap_open + (n - 1) * gap_extend.  The antidiagonals of all pairs
of a batch are taken at once, a few array operations each.  Scores and end positions come
first; rows, begins and edit strings are found in the letters that an alignment of the score
can span, begins and edit strings only for the pairs that a filter lets through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose comparison scores 0, as in a matrix over A, C, G, T and others.
_BASE = np.full(0x110000, 4, np.uint8)
for _i, _letters in enumerate(("AaUu", "Cc", "Gg", "Tt")):
    _BASE[[ord(c) for c in _letters]] = _i
#: Cells of an antidiagonal that go together, and column scores that are kept at once.
_LANE, _KEPT = 48_000, 16_000_000
#: Letters of the seeds round which windows are aligned.
SEED = 12
RESULT = "score int, ref_end int, query_end int, score2 int, ref_end2 int, ref_begin int, query_begin int, cigar string, mismatches int"


@dataclass(frozen=True)
class Scoring:
    """bases: compare as bases, all other letters scoring 0; else letters as they are.
    matrix: 25 scores of the base codes in place of match and mismatch."""

    match: int = 2
    mismatch: int = 2
    gap_open: int = 3
    gap_extend: int = 1
    bases: bool = True
    matrix: tuple[int, ...] | None = None
    #: Base codes 0 to 4 by letter, in place of the usual ones; others have code 4.
    translation: tuple[tuple[str, int], ...] | None = None

    def codes(self, s: str) -> np.ndarray:
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.bases and self.translation is not None:
            out = np.full(len(points), 4, np.uint8)
            for letter, code in self.translation:
                out[points == ord(letter)] = code
            return out
        return _BASE[points] if self.bases else points

    def seedless(self, n: int) -> int:
        """The most that an alignment of a query of n letters without SEED equal letters in a
        row can score."""
        if self.bases or self.matrix:
            return self.match * n
        return self.match * n - min(self.mismatch, self.gap_open, self.gap_extend) * max(0, -(-n // (SEED - 1)) - 1)

    def table(self) -> np.ndarray:
        if self.matrix:
            return np.array(self.matrix, np.int32).reshape(5, 5)
        t = np.full((5, 5), -self.mismatch, np.int32)
        np.fill_diagonal(t, self.match)
        t[4, :] = t[:, 4] = 0
        return t

    def row(self, letter: np.ndarray, refs: np.ndarray) -> np.ndarray:
        if self.bases:
            return self.table()[letter[:, None], refs]
        return np.where(letter[:, None] == refs, self.match, -self.mismatch).astype(np.int32)


def _fill(queries: list[np.ndarray], refs: list[np.ndarray], s: Scoring, keep: bool = False):
    """For each pair the best score of every reference column and the first query row that
    reaches it; with keep, the matrices H, E, F of the first pair as well."""
    n, m = max(map(len, queries)), max(map(len, refs))
    q, r = np.zeros((len(queries), n), np.uint32), np.zeros((len(refs), m), np.uint32)
    for i, (a, b) in enumerate(zip(queries, refs)):
        q[i, : len(a)], r[i, : len(b)] = a, b
    q_len = np.array([len(a) for a in queries])
    outside = np.arange(m)[None, :] >= np.array([len(b) for b in refs])[:, None]
    steps = np.arange(m, dtype=np.int32) * s.gap_extend
    h, e = np.zeros((len(queries), m), np.int32), np.full((len(queries), m), -(1 << 28), np.int32)
    top, at, saved = np.zeros_like(h), np.full(h.shape, -1, np.int32), []
    for i in range(n):
        diagonal = np.empty_like(h)
        diagonal[:, 0], diagonal[:, 1:] = 0, h[:, :-1]
        e = np.maximum(h - s.gap_open, e - s.gap_extend)
        t = np.maximum(np.maximum(diagonal + s.row(q[:, i], r), e), 0)
        run = np.maximum.accumulate(t + steps, axis=1)
        f = np.full_like(h, -(1 << 28))
        f[:, 1:] = run[:, :-1] - s.gap_open - steps[:-1]
        h = np.maximum(t, f)
        h[outside] = 0
        live = (i < q_len)[:, None] & (h > top)
        top[live], at[live] = h[live], i
        if keep:
            saved.append((h[0].copy(), e[0].copy(), f[0].copy()))
    return (top, at, saved) if keep else (top, at)


def _sweep(pairs: list[tuple[np.ndarray, np.ndarray]], s: Scoring) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair (query, reference), neither empty, the best score of every reference
    column, and the scores of all query rows in the last column.  All pairs go through their
    antidiagonals at once, one cell a query letter, behind one cell that stays 0: a cell's
    neighbours are its own and the one before it on the last diagonals, so that a step is a few
    operations on short arrays of small numbers.  Longest references come first, and pairs that
    have ended are left out."""
    order = sorted(range(len(pairs)), key=lambda i: -len(pairs[i][0]) - len(pairs[i][1]))
    out: list = [None] * len(pairs)
    while order:
        cells, part = 0, []
        for i in order:
            cells += len(pairs[i][0]) + 1
            if part and (cells > _LANE or (len(part) + 1) * len(pairs[order[0]][1]) > _KEPT):
                break
            part.append(i)
        order = order[len(part) :]
        for i, found in zip(part, _diagonals([pairs[i] for i in part], s)):
            out[i] = found
    return out


def _diagonals(pairs: list[tuple[np.ndarray, np.ndarray]], s: Scoring) -> list[tuple[np.ndarray, np.ndarray]]:
    n, m = np.array([len(q) for q, _ in pairs]), np.array([len(r) for _, r in pairs])
    best = max(s.match, *s.matrix) if s.bases and s.matrix else s.match
    kind = np.int16 if int(n.max()) * abs(best) + 4 * max(s.mismatch, s.gap_open, s.gap_extend, abs(best), *map(abs, s.matrix or (0,))) < 32_000 else np.int32
    first = np.concatenate([[0], np.cumsum(n + 1)])
    width, guard, first = int(first[-1]), first[:-1], first[:-1] + 1
    last, steps = first + n - 1, n + m - 1
    # letters by small codes: 0 for those in no query and beyond the ends
    known = np.unique(np.concatenate([q for q, _ in pairs]))
    code = np.uint8 if len(known) < 255 else np.uint32
    letters, query = np.zeros((int(steps.max()), len(pairs)), code), np.full(width, len(known) + 1, code)
    for p, (q, r) in enumerate(pairs):
        at = np.searchsorted(known, r).clip(max=len(known) - 1)
        letters[: len(r), p] = np.where(known[at] == r, at + 1, 0)
        query[first[p] : first[p] + len(q)] = np.searchsorted(known, q) + 1
    scores = None
    if s.bases:  # by both codes; letters in no query are told apart, as their scores may differ
        known = np.arange(5)
        for p, (q, r) in enumerate(pairs):
            letters[: len(r), p] = r + 1
            query[first[p] : first[p] + len(q)] = q + 1
        scores = np.full((7, 7), -1, kind)
        scores[1:6, 1:6] = s.table()
        row = query.clip(max=6).astype(np.int64) * 7
    same, beside = kind(s.match + s.mismatch), kind(s.mismatch)
    opened, extended, zero = kind(s.gap_open), kind(s.gap_extend), kind(0)
    new = lambda: np.zeros(width, kind)
    h, h1, h2, t, e, e1, top, top1, work = (new() for _ in range(9))
    f = new() - opened
    e1 -= opened
    ref, ref1, equal = np.zeros(width, code), np.zeros(width, code), np.zeros(width, bool)
    tops, final = np.zeros(letters.shape, kind), np.zeros(width, kind)
    live, size = len(pairs), width
    for d in range(len(letters)):
        while steps[live - 1] <= d:
            live -= 1
            size = int(guard[live])
        a, b, g = slice(1, size), slice(0, size - 1), guard[:live]
        ref[a] = ref1[b]
        ref[first[:live]] = letters[d, :live]
        np.subtract(h1[b], opened, out=e[a])
        np.subtract(e1[b], extended, out=work[b])
        np.maximum(e[a], work[b], out=e[a])
        np.subtract(f[:size], extended, out=f[:size])
        np.subtract(t[:size], opened, out=work[:size])
        np.maximum(f[:size], work[:size], out=f[:size])
        if scores is None:
            np.equal(ref[a], query[a], out=equal[a])
            np.multiply(equal[a], same, out=t[a])
            np.subtract(t[a], beside, out=t[a])
        else:
            t[a] = scores.ravel()[row[a] + ref[a]]
        np.add(t[a], h2[b], out=t[a])
        np.maximum(t[a], e[a], out=t[a])
        np.maximum(t[a], zero, out=t[a])
        np.maximum(t[a], f[a], out=h[a])
        h[g], e[g] = 0, -opened
        np.maximum(top1[b], h[a], out=top[a])
        top[g] = 0
        tops[d, :live] = top[last[:live]]
        i = d - m[:live] + 1
        there = np.flatnonzero((i >= 0) & (i < n[:live]))
        if len(there):
            spot = first[there] + i[there]
            final[spot] = h[spot]
        h, h1, h2, e, e1, top, top1, ref, ref1 = h2, h, h1, e1, e, top1, top, ref1, ref
    return [(tops[x - 1 : x - 1 + y, p].copy(), final[first[p] : first[p] + x].copy()) for p, (x, y) in enumerate(zip(n, m))]


def _ends(top: np.ndarray, mask: int) -> tuple[int, int, int, int]:
    """score, ref_end, and the best score and column beyond `mask` of ref_end."""
    column = int(np.argmax(top))
    score = int(top[column])
    if score <= 0:
        return 0, -1, 0, -1
    if mask < 15:
        return score, column, 0, -1
    rest = top.copy()
    rest[max(0, column - mask) : min(len(top), column + mask)] = 0
    second = int(np.argmax(rest))
    return score, column, int(rest[second]), second if rest[second] > 0 else -1


def _reach(query: np.ndarray, score: int, s: Scoring) -> int | None:
    """The most reference letters of an alignment of a score: a gap of k letters costs k times
    the least gap cost.  None: no bound."""
    least = min(s.gap_open, s.gap_extend)
    best = max(s.match, *s.matrix) if s.bases and s.matrix else s.match
    return len(query) + max(0, best * len(query) - score) // least if least > 0 else None


def _query_ends(found: list[tuple[np.ndarray, np.ndarray, int, int]], s: Scoring) -> list[int]:
    """The first query row that reaches the score in its column, of (query, reference, score,
    column): the alignments that do lie in the letters before it."""
    cut = []
    for q, r, score, column in found:
        reach = _reach(q, score, s)
        cut.append((q, r[0 if reach is None else max(0, column + 1 - reach) : column + 1]))
    return [int(np.argmax(final)) for _, final in _sweep(cut, s)]


def _windows(query: np.ndarray, ref: np.ndarray, s: Scoring) -> list[tuple[int, int]]:
    """[first, end) of the reference's parts that hold every alignment of positive score with
    SEED equal letters in a row: a gap of n letters costs n at least, so none spans more than
    the query and its score."""
    own, other = query.astype("<u4").tobytes(), ref.astype("<u4").tobytes()
    places = set()
    for i in range(len(query) - SEED + 1):
        gram = own[4 * i : 4 * (i + SEED)]
        at = other.find(gram)
        while at >= 0:
            if at % 4 == 0:
                places.add(at // 4)
            at = other.find(gram, at + 1)
    reach = len(query) * (1 + s.match) + 1
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        a, b = max(0, p - reach), min(len(ref), p + SEED + reach)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def best_ends(coded: list[tuple[int, np.ndarray, np.ndarray]], s: Scoring) -> dict[int, tuple[int, int, int]]:
    """By number of the pair score, ref_end and query_end of those pairs whose windows round
    seeds suffice: no alignment without a seed scores as much as the best one found."""
    if s.gap_extend < 1:
        return {}
    parts = [(i, a, q, r[a:b]) for i, q, r in coded if len(q) >= SEED for a, b in _windows(q, r, s)]
    best: dict[int, tuple[int, int, np.ndarray, np.ndarray, int]] = {}
    for (i, a, q, r), (top, _) in zip(parts, _sweep([x[2:] for x in parts], s)):
        score, column = _ends(top, 0)[:2]
        if score > s.seedless(len(q)) and (i not in best or (-score, a + column) < (-best[i][0], best[i][1])):
            best[i] = score, a + column, q, r, column
    rows = _query_ends([(q, r, score, column) for score, _, q, r, column in best.values()], s)
    return {i: (score, end, row) for (i, (score, end, *_)), row in zip(best.items(), rows)}


def trace(query: np.ndarray, ref: np.ndarray, s: Scoring) -> tuple[str, int]:
    """The edit string, M split into = and X, of the best alignment that ends at the last letters
    of both, and its mismatches with inserted and deleted letters counted."""
    if not s.bases and s.match > 0 and np.array_equal(query, ref):
        return f"{len(query)}=", 0
    _, _, rows = _fill([query], [ref], s, keep=True)
    i, j, state, ops = len(query) - 1, len(ref) - 1, "H", []
    while i >= 0 and j >= 0:
        h, e, f = rows[i]
        if state == "H":
            if h[j] <= 0:
                break
            before = rows[i - 1][0][j - 1] if i and j else 0
            if h[j] == before + s.row(query[i : i + 1], ref[None, j : j + 1])[0, 0]:
                ops.append("=" if query[i] == ref[j] else "X")
                i, j = i - 1, j - 1
            else:
                state = "E" if h[j] == e[j] else "F"
        elif state == "E":
            ops.append("I")
            opened = (rows[i - 1][0][j] if i else 0) - s.gap_open == e[j]
            i, state = i - 1, "H" if opened else "E"
        else:
            ops.append("D")
            opened = (rows[i][0][j - 1] if j else 0) - s.gap_open == f[j]
            j, state = j - 1, "H" if opened else "F"
    ops.reverse()
    out, last = [], 0
    for k in range(1, len(ops) + 1):
        if k == len(ops) or ops[k] != ops[last]:
            out.append(f"{k - last}{ops[last]}")
            last = k
    return "".join(out), sum(x != "=" for x in ops)


def align_all(queries: list[str | None], refs: list[str | None], s: Scoring, mask: int | None, least_score: int | None, most_span: int) -> list[tuple]:
    """Results in the order of the pairs; begins and edit strings from least_score on (None:
    for none) and for spans up to most_span."""
    out: list[tuple] = [(0, -1, -1, 0, -1, -1, -1, None, None)] * len(queries)
    coded = [(i, s.codes(q), s.codes(r)) for i, (q, r) in enumerate(zip(queries, refs)) if q and r]
    if mask is not None and mask < 15 and least_score is None:  # the ends alone are asked for
        known = best_ends(coded, s)
        for i, ends in known.items():
            out[i] = (*ends, 0, -1, -1, -1, None, None)
        coded = [x for x in coded if x[0] not in known]
    ends = [_ends(top, len(q) if mask is None else mask) for (_, q, _), (top, _) in zip(coded, _sweep([x[1:] for x in coded], s))]
    hit = [(i, q, r, *x) for (i, q, r), x in zip(coded, ends) if x[0] > 0]
    rows = _query_ends([x[1:5] for x in hit], s)
    begun = [k for k, x in enumerate(hit) if least_score is not None and x[3] >= least_score]
    # backwards from the end, where the score is reached in the same letters only
    back = []
    for k in begun:
        _, q, r, score, column, *_ = hit[k]
        reach = _reach(q, score, s)
        back.append((q[: rows[k] + 1][::-1], r[0 if reach is None else max(0, column + 1 - reach) : column + 1][::-1]))
    spots = [int(np.argmax(top)) for top, _ in _sweep(back, s)]
    lines = _query_ends([(q, r, hit[k][3], spot) for k, (q, r), spot in zip(begun, back, spots)], s)
    begins = {k: (hit[k][4] - spot, rows[k] - line) for k, spot, line in zip(begun, spots, lines)}
    for k, ((i, q, r, score, column, *second), row) in enumerate(zip(hit, rows)):
        begin, text, bad = begins.get(k, (-1, -1)), None, None
        if k in begins and column - begin[0] <= most_span:
            text, bad = trace(q[begin[1] : row + 1], r[begin[0] : column + 1], s)
            lead, lag = begin[1], len(q) - 1 - row
            text = f"{lead}S" * bool(lead) + text + f"{lag}S" * bool(lag)
        out[i] = (score, column, row, *second, *begin, text, bad)
    return out


def aligner(s: Scoring = Scoring(), mask: int | None = None, least_score: int | None = 0, most_span: int = 32_767) -> Callable[[Column, Column], Column]:
    """A function of (query, reference) columns that gives RESULT as a struct; a reference may
    be a literal, for many queries against one.  Null or
    empty sequences score 0 with positions -1.  mask defaults to the query's length; one
    under 15 asks for no second score; with neither that nor begins, parts of long references
    that can't hold the best alignment are left out."""

    @F.pandas_udf(RESULT)
    def of(query: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = align_all(query.tolist(), reference.tolist(), s, mask, least_score, most_span)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"mismatches": "Int32"})

    return of
