"""Licence scan over a positional rare-token index.

Document frequencies of all licence words are counted over every file.  Each template is indexed under its
``index_words`` words of highest inverse document frequency, as postings ``word -> (template, position)``.
A file's occurrences of indexed words vote for (template, file position - template position); votes of at least
``need`` distinct indexed words at (nearly) one relative position make a candidate, which is then verified: all
mandatory key phrases of the template must stand there word for word, and ``min_coverage`` of the template's words
must be in place.  A template with gaps ("...") is indexed and verified passage by passage, each at its own position;
its passages must follow each other, before its first passage stands again.

Two passes over the texts, neither with a shuffle; what is broadcast is the template index, whose size is that
of the template list and independent of the data.

Defined results:

* null, empty and wordless texts have no licence; a text is read whole, and every occurrence is reported;
* ``doc_id`` may have any type and is carried through, null too; repeated rows are reported one by one, alike;
* several templates at the same place are all reported; of two candidates of one template that overlap the one
  with the better coverage stands, the earlier on ties; words of equal frequency are indexed in alphabetical order;
* an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from codestrata.storage import ship
from codestrata.llm.license_texts import NOTICES, TEXTS
from codestrata.llm.sums import partition_sum
from codestrata.llm.textkernel import Words, slices

INDEX_WORDS, SLACK, MIN_COVERAGE = 5, 3, 0.7
SCHEMA = "license string, first_word long, n_words long, start_byte long, end_byte long, votes long, coverage double"

TEMPLATES = [*NOTICES, *TEXTS]


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _hashes(words: list[str]) -> np.ndarray:
    w = Words(pa.array([" ".join(words)], pa.large_string()))
    return w.h


@dataclass
class Template:
    name: str
    words: np.ndarray
    phrases: list[np.ndarray]


class RareIndex:
    """Postings of each template's rarest words."""

    def __init__(self, templates, frequency: dict[str, float], n_docs: float, index_words: int, min_coverage: float):
        self.templates, self.passages, texts = [], [], []
        for name, whole, phrases in templates:
            own = [f" {' '.join(tokens(x))} " for x in whole.split("...")]
            self.passages.append(range(len(texts), len(texts) + len(own)))
            texts += own
            homes = [next((j for j, x in enumerate(own) if f" {' '.join(tokens(p))} " in x), 0) for p in phrases]
            self.templates += [Template(name, _hashes(tokens(x)), [_hashes(tokens(p)) for p, home in zip(phrases, homes) if home == j]) for j, x in enumerate(own)]
        self.min_coverage, self.need, posts = min_coverage, [], []
        for k, text in enumerate(texts):
            own = tokens(text)
            idf = {w: np.log((1 + n_docs) / (1 + frequency.get(w, 0))) for w in own}
            rare = sorted(set(own), key=lambda w: (-idf[w], w))[:index_words]
            self.need.append(max(1, int(np.ceil(0.6 * len(rare)))))
            posts += [(h, k, p) for w, h, p in zip(own, self.templates[k].words.tolist(), range(len(own))) if w in rare]
        posts.sort()
        self.hash = np.array([h for h, _, _ in posts], np.uint64)
        self.template = np.array([k for _, k, _ in posts], np.int64)
        self.place = np.array([p for _, _, p in posts], np.int64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scan(self, w: Words) -> list[tuple]:
        """(row, template, first word, number of words, votes, coverage) of verified licences."""
        at = np.flatnonzero(self.table[(w.h & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, w.h[at]), np.searchsorted(self.hash, w.h[at], side="right")
        n = hi - lo
        if not n.sum():
            return []
        pos = np.repeat(at, n)
        post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(w.ptr, pos, side="right") - 1
        k, offset = self.template[post], pos - self.place[post]
        order = np.lexsort((offset, k, doc))
        doc, k, offset, word = doc[order], k[order], offset[order], self.hash[post][order]
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (offset[1:] - offset[:-1] > SLACK)) + 1
        found = []
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(doc)].tolist()):
            t = int(k[a])
            if b - a < self.need[t] or (votes := len(np.unique(word[a:b]))) < self.need[t]:
                continue
            row = int(doc[a])
            # within the run, every relative position that the votes hold is tried
            for o in np.unique(offset[a:b]).tolist():
                if (v := self._verify(w, row, t, o)) is not None:
                    found.append((row, t, *v, votes))
        return self._joined(self._best(found))

    def _verify(self, w: Words, row: int, t: int, o: int):
        tpl = self.templates[t]
        lo, hi = w.ptr[row], w.ptr[row + 1]
        a, b = max(lo, o - SLACK), min(hi, o + len(tpl.words) + SLACK)
        own = w.h[a:b]
        for p in tpl.phrases:
            if not any((own[i : i + len(p)] == p).all() for i in np.flatnonzero(own[: max(0, len(own) - len(p) + 1)] == p[0])):
                return None
        placed = sum(bool((own[max(0, o + i - SLACK - a) : max(0, o + i + SLACK + 1 - a)] == h).any()) for i, h in enumerate(tpl.words))
        coverage = placed / len(tpl.words)
        if coverage < self.min_coverage:
            return None
        start = max(o, lo)
        return int(start - lo), int(min(hi, o + len(tpl.words)) - start), coverage

    def _best(self, found: list[tuple]) -> list[tuple]:
        taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
        out = []
        for row, t, first, n, coverage, votes in sorted(found, key=lambda f: (-f[4], f[2])):
            spans = taken.setdefault((row, t), [])
            if n > 0 and all(first >= e or first + n <= s for s, e in spans):
                spans.append((first, first + n))
                out.append((row, t, first, n, votes, coverage))
        return sorted(out)


    def _joined(self, found: list[tuple]) -> list[tuple]:
        """Of the passages of templates with gaps, those that follow each other, as one; the rest as it is."""
        at: dict[int, dict[int, list[tuple]]] = {}
        for f in found:
            at.setdefault(f[0], {}).setdefault(f[1], []).append(f)
        out = []
        for passages in self.passages:
            for row, of in at.items():
                first = of.get(passages[0], [])
                for i, f in enumerate(first):
                    chain, end = [f], first[i + 1][2] if i + 1 < len(first) else np.inf
                    for t in passages[1:]:
                        f = next((g for g in of.get(t, []) if f[2] + f[3] - SLACK <= g[2] < end and g[2] > f[2]), None)
                        if f is None:
                            break
                        chain.append(f)
                    if len(chain) == len(passages):
                        size = [len(self.templates[g[1]].words) for g in chain]
                        coverage = chain[0][5] if len(chain) == 1 else float(np.dot([g[5] for g in chain], size) / sum(size))
                        out.append((row, passages[0], chain[0][2], chain[-1][2] + chain[-1][3] - chain[0][2], sum(g[4] for g in chain), coverage))
        return sorted(out)


def _frequencies(d: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Number of texts with each word of ``vocabulary``, over all texts, and the number of texts."""
    h = np.concatenate([_hashes([w]) for w in vocabulary])
    order = np.argsort(h)
    known = h[order]
    size = len(known)

    def add(batch, total):
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            i = np.minimum(np.searchsorted(known, w.h), size - 1)
            ok = known[i] == w.h
            seen = np.unique(w.text_of_word()[ok] * size + i[ok])
            total[:size] += np.bincount(seen % size, minlength=size)
            total[size] += part.num_rows

    total = partition_sum(d.select("text"), size + 1, add)
    return {vocabulary[o]: total[i] for i, o in enumerate(order.tolist())}, total[size]


def scan(docs: DataFrame, templates=TEMPLATES, index_words: int = INDEX_WORDS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each licence that stands in a file."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([d.schema["doc_id"], *_parse_datatype_string(SCHEMA).fields])
    vocabulary = sorted({w for _, t, _ in templates for w in tokens(t)})
    if not vocabulary:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(RareIndex(templates, *_frequencies(d, vocabulary), index_words, min_coverage))

    def kernel(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                found = index.scan(w)
                if not found:
                    continue
                rows = [(index.templates[t].name, first, n, int(w.start[w.ptr[r] + first] - w.off[r]), int(w.end[w.ptr[r] + first + n - 1] - w.off[r]), votes, coverage) for r, t, first, n, votes, coverage in found]
                kinds = [pa.string(), *[pa.int64()] * 5, pa.float64()]
                ids = part.column("doc_id").take(pa.array([f[0] for f in found]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return d.mapInArrow(kernel, schema)
