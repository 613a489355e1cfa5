"""License scans by patience alignment.

A text and a license template are aligned on anchors: words that occur once in the text's region and once in the template. The longest
increasing subsequence of anchors is kept, and the gaps between them are aligned again in the same way, after equal words at a
gap's ends; a gap without anchors is aligned by its longest common subsequence. Coverage is the share of the
template's words that are aligned.

Regions: a license can only reach ``COVERAGE`` if at least one of its telling words is matched (its rarest words that make up
more than 1 - COVERAGE of it), so only the surroundings of telling words are aligned. Regions of one template that touch are one;
what the alignment found is then taken out and the rest of the region is aligned again, so that repeated notices are counted.
Where telling words stand more often than in the template, the region may hold several copies, whose words hide each other's anchors: there
a window of about one template length around every place where a telling word would begin a copy is aligned first.

Defined cases: null or empty text has no license; words are compared without marks around them and without case (A-Z); of templates whose
matched stretches overlap, that with more matched words is reported, then the one of higher coverage, then the first by
name; very long texts are read whole; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import kernels as K
from fieldweave.llm.workspace import lean
from fieldweave.llm.license_texts import TEMPLATES

COVERAGE = 0.8
EVERYDAY = {"a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you", "under", "work", "not", "if", "see", "all", "free", "can", "may", "use"}

_solid = np.zeros(256, bool)
_solid[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def cores(buf: np.ndarray, offs: np.ndarray) -> tuple[K.Words, np.ndarray]:
    """The words of a slice and the hashes of their cores (no marks around, lower case); a word of marks only keeps them."""
    w = K.Words(buf, offs)
    if not len(w.start):
        return w, w.hash
    ok, at = _solid[w.low], np.arange(len(buf))
    after = np.maximum.accumulate(np.where(ok, at + 1, 0))[w.end - 1]
    before = np.minimum.accumulate(np.where(ok, at, len(buf))[::-1])[::-1][w.start]
    bare = after <= before
    return w, w.spans(np.where(bare, w.start, before), np.where(bare, w.end, after))


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose seconds increase: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, second) in enumerate(pairs):
        p = bisect_left(tops, second)
        if p == len(tops):
            tops.append(second)
            at.append(k)
        else:
            tops[p], at[p] = second, k
        back[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as index pairs: a row of the table is one integer of len(b) bits, unset where it steps up."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    rows = []
    for x in a:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def aligned(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Index pairs of aligned words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {template[j]: j for j in range(c, d) if there[template[j]] == 1}
        anchors = increasing([(i, place[text[i]]) for i in range(a, b) if here[text[i]] == 1 and text[i] in place])
        if not anchors:
            out += [(a + i, c + j) for i, j in _common(text[a:b], template[c:d])]
            continue
        out += anchors
        for (i, j), (x, y) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, x, j + 1, y))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        raw = np.frombuffer(text.encode(), np.uint8)
        w, h = cores(raw, np.array([0, len(raw)]))
        self.name, self.words = name, h.tolist()
        plain = ["".join(ch for ch in x.lower() if ch.isalnum() or ch in ".-/:") for x in text.split()]
        seen = Counter(self.words)
        telling: set[int] = set()
        by = sorted(range(len(plain)), key=lambda k: (plain[k].strip(".:") in EVERYDAY, seen[self.words[k]], -len(plain[k]), k))
        for k in by:
            if sum(seen[x] for x in telling) > (1 - COVERAGE) * len(self.words):
                break
            telling.add(self.words[k])
        self.telling = np.array(sorted(telling), np.uint64)
        self.places: dict[int, list[int]] = {}
        for j, x in enumerate(self.words):
            if x in telling:
                self.places.setdefault(x, []).append(j)


def _drawn_in(text: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same template words on the equal text words nearest to the middle pair: a copy does not end in its neighbour."""
    out, mid = list(pairs), len(pairs) // 2
    for k in range(mid + 1, len(out)):
        out[k] = (text.index(text[out[k][0]], out[k - 1][0] + 1), out[k][1])
    for k in range(mid - 1, -1, -1):
        i = out[k + 1][0] - 1
        while text[i] != text[out[k][0]]:
            i -= 1
        out[k] = (i, out[k][1])
    return out


def _copy(words: list[int], places: list[int], t: Template, lo: int, hi: int) -> list[tuple[int, int]]:
    """The aligned pairs (places in ``words``) of the first copy in a region whose telling words repeat; none if there is no such copy."""
    n, out = len(t.words), []
    here = places[bisect_left(places, lo) : bisect_left(places, hi)]
    if all(k <= len(t.places[x]) for x, k in Counter(words[p] for p in here).items()):
        return out
    step, margin = max(1, n // 8), n // 4 + 1
    for start in sorted({(p - j) // step * step for p in here for j in t.places[words[p]]}):
        a, b = max(lo, start - margin), min(hi, start + n + step + margin)
        while b - a >= COVERAGE * n:
            pairs = _tight(_drawn_in(words[a:b], aligned(words[a:b], t.words)), 2 * n)
            if len(pairs) < COVERAGE * n or len(pairs) <= len(out):
                break
            out = [(a + i, j) for i, j in pairs]
            a, b = max(lo, out[0][0] - margin), min(hi, out[-1][0] + 1 + margin)
        if out:
            break
    return out


def scan_words(words: list[int], telling: dict[str, list[int]], templates: dict[str, Template]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched, first word, end word) of one text; ``telling`` has the places of each template's telling words."""
    found = []
    for name, places in telling.items():
        t = templates[name]
        reach = 2 * len(t.words)
        regions: list[list[int]] = []
        for p in places:
            if regions and p - reach <= regions[-1][1]:
                regions[-1][1] = min(len(words), p + reach)
            else:
                regions.append([max(0, p - reach), min(len(words), p + reach)])
        todo = [(lo, hi, True) for lo, hi in regions]
        while todo:
            lo, hi, several = todo.pop()
            pairs = [(i - lo, j) for i, j in _copy(words, places, t, lo, hi)] if several else []
            windowed = bool(pairs)
            if not windowed:
                pairs = _tight(aligned(words[lo:hi], t.words), 2 * len(t.words))
            if len(pairs) < COVERAGE * len(t.words):
                # repeated words can hide all anchors: halves that each hold telling words are tried alone
                if hi - lo > 2 * reach:
                    mid = (lo + hi) // 2
                    todo += [(lo, min(hi, mid + len(t.words)), False), (max(lo, mid - len(t.words)), hi, False)]
                continue
            first, end = lo + pairs[0][0], lo + pairs[-1][0] + 1
            found.append((name, len(pairs) / len(t.words), len(pairs), first, end))
            todo += [r for r in ((lo, first, several and not windowed), (end, hi, several)) if r[1] - r[0] >= COVERAGE * len(t.words)]
    found.sort(key=lambda r: (-r[2], -r[1], r[0], r[3]))
    kept: list[tuple[str, float, int, int, int]] = []
    for r in found:
        if all(r[4] <= k[3] or r[3] >= k[4] for k in kept):
            kept.append(r)
    return sorted(kept, key=lambda r: r[3])


def _tight(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The most pairs within a stretch of ``width`` words: far-off single words are no part of a notice."""
    best, lo = (0, 0), 0
    for hi in range(len(pairs)):
        while pairs[hi][0] - pairs[lo][0] >= width:
            lo += 1
        best = max(best, (hi - lo + 1, -lo))
    return pairs[-best[1] : -best[1] + best[0]]


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, first_word and end_word of every license found."""
    lean(documents)
    given = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: Template(k, v) for k, v in given.items()}
        every = np.unique(np.concatenate([t.telling for t in ready.values()])) if ready else np.zeros(0, np.uint64)
        for batch in batches:
            for lo, _, buf, offs in K.slices(batch.column(1)):
                w, h = cores(buf, offs)
                hit = np.flatnonzero(every[np.minimum(np.searchsorted(every, h), len(every) - 1)] == h) if len(every) else np.zeros(0, np.int64)
                row = np.searchsorted(w.first, hit, side="right") - 1
                out: list[tuple] = []
                for r in np.unique(row):
                    at = hit[row == r]
                    telling = {k: (at[np.isin(h[at], t.telling)] - w.first[r]).tolist() for k, t in ready.items()}
                    out += [(int(lo + r), *x) for x in scan_words(h[w.first[r] : w.last[r]].tolist(), {k: v for k, v in telling.items() if v}, ready)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=["doc_id", "license", "coverage", "matched_words", "first_word", "end_word"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, first_word long, end_word long")
