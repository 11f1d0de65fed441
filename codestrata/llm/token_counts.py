"""Edit-aware token counts.

Byte-pair encoders split a text into pre-tokens and encode each by itself, so a text's token count is a sum over
its pre-tokens.  :func:`build` splits and encodes each text once and gives a table that is to be kept: beside the text a
segment tree over blocks of pre-tokens, with the sums of tokens and of characters at every node.  An edit finds its
block down the sums of characters, touches the pre-tokens it overlaps and, through the splitter's look-ahead, at most a
few before and after: only that region is split and encoded again, from two pre-tokens before the edit to the first new
boundary that falls on an old one behind it, and the sums on the touched blocks' paths to the root are updated.
Blocks hold their own characters and lengths, nothing absolute, so blocks behind an edit stay as they are; they grow
and shrink, and only when one overflows the sums are laid out anew.

:func:`recount` gives the counts before and after edits from kept trees, :func:`update` the trees after them; of texts
without edits neither reads more than the kept count.  Nothing is encoded twice and neither step shuffles.  The splitter
is vectorised over code points (it gives the same pre-tokens as the pattern of the tokenizer), and every distinct
pre-token is encoded once per worker (a worker's memory of them is emptied at ``KNOWN``; that changes no result).

Vocabulary: a file of byte-pair ranks, read on the driver from ``path`` and broadcast (its size is fixed).

Defined results:

* null text: no tokens, no tree, edits of it are ignored; empty text: zero tokens, insertions work;
* edits are applied one after another, each to the result of those before; positions and lengths are clipped to
  the text (in code points), a null position, length or insertion counts as 0, 0, empty; a null edit list is empty;
* ``doc_id`` may have any type and is carried through, null too; repeated rows are counted one by one; texts are read
  whole, whatever their length; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from codestrata.llm.textkernel import mix, slices
from codestrata.storage import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, KNOWN, FEW = 64, 2_000_000, 256
EDITS = "array<struct<at: long, remove: long, insert: string>>"
COUNTS = "tokens_before long, tokens_after long, n_edits long, pretokens long, reencoded_pretokens long, updated_nodes long"
TREE = "text string, tokens long, pretokens long, sizes binary, lengths binary, counts binary, sums binary"
_SLICE = 512 << 10
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the pattern's engine sees it."""
    import regex

    t = np.zeros(0x110000, np.uint8)
    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            t[m.start() : m.end()] = k
    return t


def starts(code: np.ndarray, edge: np.ndarray | None = None) -> np.ndarray:
    """Where pre-tokens start in code points ``code``; ``edge``: starts of texts in it (by default one text)."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[code]
    first = np.zeros(n, bool)
    first[0 if edge is None else edge[edge < n]] = True
    begin = first.copy()
    begin[1:] |= c[1:] != c[:-1]
    run = begin.nonzero()[0]  # runs of one class within a text
    kind, end = c[run], np.append(run[1:], n)
    # a run of white space gives its last character to what follows: as that run's own leading blank, or alone
    space = (kind == SPACE).nonzero()[0]
    next_ = end[space]
    last = next_ - 1
    followed = (next_ < n) & ~first[np.minimum(next_, n - 1)]
    join = followed & (code[last] == 32)
    many = followed & (last > run[space])
    begin[last[many]] = True
    begin[next_[join]] = False
    # contractions: an apostrophe that starts a pre-token, then s t m d or re ve ll
    apostrophe = (code == 39).nonzero()[0]
    if len(apostrophe):
        limit = np.append(np.flatnonzero(first), n)
        for p in apostrophe[begin[apostrophe]].tolist():
            stop = limit[np.searchsorted(limit, p, side="right")]
            two = bytes(min(x, 255) for x in code[p + 1 : min(p + 3, stop)].tolist())
            size = 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"re", b"ve", b"ll") else 0
            if not size:
                continue
            begin[p + 1 : p + 1 + size] = False
            if p + 1 + size < stop:
                begin[p + 1 + size] = True
                # "'s" is cut off what follows: a blank behind it starts a run as before
    return np.flatnonzero(begin)


class Counter:
    """Token counts of pre-tokens; each distinct one, told by a 64-bit hash, is encoded once."""

    def __init__(self, ranks: bytes):
        self.ranks, self.encoding, self.known = ranks, None, {}

    def __getstate__(self):
        return self.ranks

    def __setstate__(self, ranks):
        self.__init__(ranks)

    def tokenizer(self):
        if self.encoding is None:
            import tiktoken

            pairs = (line.split() for line in self.ranks.splitlines() if line)
            self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        return self.encoding

    def many(self, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Counts of the pre-tokens of ``code`` that start at ``begin``."""
        if not len(begin):
            return np.zeros(0, np.int64)
        p, inv = _powers(len(code))
        pre = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * p, out=pre[1:])
        end = np.append(begin[1:], len(code))
        h = mix((pre[end] - pre[begin]) * inv[begin])
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        if len(h) <= FEW:  # an edit's stretch: sorting costs more than it spares
            counts = [known.get(x, -1) for x in h.tolist()]
            for i, x in enumerate(counts):
                if x < 0:
                    counts[i] = known[int(h[i])] = len(self.tokenizer()._encode_single_piece(code[begin[i] : end[i]].tobytes().decode("utf-32-le", "replace")))
            return np.array(counts, np.int64)
        key, at, back = np.unique(h, return_index=True, return_inverse=True)
        counts = [known.get(x, -1) for x in key.tolist()]
        new = [i for i, x in enumerate(counts) if x < 0]
        if new:
            encode, key = self.tokenizer()._encode_single_piece, key.tolist()
            for i in new:
                counts[i] = known[key[i]] = len(encode(code[begin[at[i]] : end[at[i]]].tobytes().decode("utf-32-le", "replace")))
        return np.array(counts, np.int64)[back]


def _powers(n: int):
    from codestrata.llm import textkernel

    return textkernel._powers(n)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + np.ascontiguousarray(x).astype(f"<u{width}").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


class Tree:
    """Segment tree over blocks of about ``BLOCK`` pre-tokens of one text.

    A block is its code points and its pre-tokens' lengths and counts; ``levels[0]`` has a row (tokens, characters) for each
    block, and every further level the sums of pairs of the level below.
    """

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], levels: list[np.ndarray] | None = None):
        self.blocks = blocks
        if levels is None:
            self._raise()
        else:
            self.levels = levels

    @classmethod
    def of(cls, code: np.ndarray, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None, levels=None) -> Tree:
        cut = [0, *accumulate(sizes.tolist())] if sizes is not None else [*range(0, len(lengths), BLOCK), len(lengths)]
        at = np.zeros(len(lengths) + 1, np.int64)
        lengths.cumsum(out=at[1:])
        place = at[cut].tolist()
        return cls([(code[p:q], lengths[i:j], counts[i:j]) for i, j, p, q in zip(cut, cut[1:], place, place[1:])], levels)

    @classmethod
    def load(cls, code: np.ndarray, sizes: bytes, lengths: bytes, counts: bytes, sums: bytes) -> Tree:
        size, flat, levels, n, at = unpack(sizes), unpack(sums).reshape(-1, 2), [], 0, 0
        n = max(1, len(size))
        while True:
            levels.append(flat[at : at + n].copy())
            at += n
            if n == 1:
                return cls.of(code, unpack(lengths), unpack(counts), size, levels)
            n = (n + 1) // 2

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        join = lambda k: np.concatenate([b[k] for b in self.blocks]) if self.blocks else np.zeros(0, np.int64)
        return pack(np.array([len(b[1]) for b in self.blocks], np.int64)), pack(join(1)), pack(join(2)), pack(np.concatenate(self.levels).ravel())

    def text(self) -> str:
        return np.concatenate([b[0] for b in self.blocks]).tobytes().decode("utf-32-le") if self.blocks else ""

    def _raise(self) -> int:
        level = np.array([(int(n.sum()), len(c)) for c, _, n in self.blocks] or [(0, 0)], np.int64)
        self.levels = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2), axis=0)
            self.levels.append(level)
        return sum(map(len, self.levels))

    @property
    def total(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def pretokens(self) -> int:
        return sum(len(b[1]) for b in self.blocks)

    def find(self, at: int) -> tuple[int, int]:
        """Block of the character ``at`` and its place in there; the text's end counts to the last block."""
        k = 0
        for level in self.levels[-2::-1]:
            k *= 2
            if k + 1 < len(level) and at >= (left := int(level[k, 1])):
                at -= left
                k += 1
        return k, at

    def edit(self, counter: Counter, at: int, remove: int, insert: np.ndarray) -> tuple[int, int]:
        """Apply one edit; (pre-tokens encoded again, nodes of the tree updated)."""
        n = int(self.levels[-1][0, 1])
        at = min(max(at, 0), n)
        remove = min(max(remove, 0), n - at)
        if not remove and not len(insert):
            return 0, 0
        if not self.blocks:
            self.blocks = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        # from two pre-tokens before the one with the character before the edit
        k, place = self.find(max(at - 1, 0))
        first = max(at - 1, 0) - place  # of block k
        i = int(self.blocks[k][1].cumsum().searchsorted(place, side="right"))
        while i < 2 and k > 0:
            k -= 1
            i += len(self.blocks[k][1])
            first -= len(self.blocks[k][0])
        i = max(0, i - 2)
        last = max(k, self.find(at + remove)[0])
        shift = len(insert) - remove
        while True:  # look ahead, by more blocks each time, until a new boundary behind the edit is an old one
            own = self.blocks[k : last + 1]
            old, lengths, counts = own[0] if len(own) == 1 else (np.concatenate([b[x] for b in own]) for x in range(3))
            code = np.concatenate([old[: at - first], insert, old[at - first + remove :]])
            begin = lengths.cumsum() - lengths
            start = int(begin[i]) if i < len(begin) else 0
            whole = last == len(self.blocks) - 1
            new = starts(code[start:]) + start
            safe = new if whole else new[new < len(code) - 8]  # the stretch's end may cut a pre-token
            # both are in order: the first old boundary behind the edit that is a new one too
            behind = int(begin.searchsorted(at - first + remove))
            moved, safe = begin[behind:] + shift, safe[safe.searchsorted(at - first + len(insert)) :]
            place = safe.searchsorted(moved)
            hit = (safe[np.minimum(place, len(safe) - 1)] == moved).nonzero()[0] if len(safe) else ()
            if len(hit) or whole:
                break
            last = min(len(self.blocks) - 1, 2 * last - k + 1)
        j = behind + int(hit[0]) if len(hit) else len(lengths)
        stop = int(begin[j]) + shift if len(hit) else len(code)
        new = new[new < stop]
        fresh = counter.many(code[start:stop], new - start)
        end = np.append(new[1:], stop) if len(new) else new
        lengths = np.concatenate([lengths[:i], end - new, lengths[j:]])
        counts = np.concatenate([counts[:i], fresh, counts[j:]])
        room = last - k + 1
        each = -(-len(lengths) // room)
        overflow = each > 2 * BLOCK
        sizes = np.diff(np.minimum(np.arange(room + 1) * each, len(lengths))) if not overflow else None
        self.blocks[k : last + 1] = Tree.of(code, lengths, counts, sizes, []).blocks
        if overflow:
            return len(new), self._raise()
        self.levels[0][k : last + 1] = [(int(c.sum()), len(x)) for x, _, c in self.blocks[k : last + 1]]
        low, high, nodes = k, last, last - k + 1  # touched nodes of a level lie side by side
        for below, level in zip(self.levels, self.levels[1:]):
            low, high = low // 2, high // 2
            nodes += high - low + 1
            pairs = below[2 * low : 2 * high + 2]
            level[low : high + 1] = pairs[::2]
            right = pairs[1::2]
            level[low : low + len(right)] += right
        return len(new), nodes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _split(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, texts' offsets, pre-token starts, and per text the range of its pre-tokens."""
    size = pc.fill_null(pc.utf8_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.r_[0, np.cumsum(size)]
    code = _points("".join(t for t in arr.to_pylist() if t))
    begin = starts(code, off[:-1])
    return code, off, begin, np.searchsorted(begin, off)


def _shared(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Counter(f.read()))


def build(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and :data:`TREE` of each row of ``docs``: the table to keep."""
    spark = docs.sparkSession
    ship(spark)
    shared = _shared(spark, path)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([d.schema["doc_id"], *_parse_datatype_string(TREE).fields])

    def kernel(batches):
        counter = shared.value
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                code, off, begin, ptr = _split(part.column("text"))
                counts, lengths = counter.many(code, begin), np.diff(np.r_[begin, len(code)])
                rows = []
                for i, null in enumerate(pc.is_null(part.column("text")).to_pylist()):
                    own = slice(ptr[i], ptr[i + 1])
                    tree = Tree.of(code[off[i] : off[i + 1]], lengths[own], counts[own])
                    rows.append((0, 0, None, None, None, None) if null else (tree.total, int(ptr[i + 1] - ptr[i]), *tree.dump()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *(pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(zip(*rows)))], names=schema.names)

    return d.mapInArrow(kernel, schema)


def _edited(trees: DataFrame, edits: str | Column, path: str, out: str, row) -> tuple[DataFrame, DataFrame]:
    """Rows with edits after them, by ``row(tree, before, done, again, nodes)``, and the rows without."""
    spark = trees.sparkSession
    ship(spark)
    edits = F.col(edits) if isinstance(edits, str) else edits
    todo = F.coalesce(F.filter(edits.cast(EDITS), lambda e: e.isNotNull()), F.array().cast(EDITS))
    d = trees.select("doc_id", *[x.split()[0] for x in TREE.split(", ")], todo.alias("todo"))
    has = F.col("text").isNotNull() & (F.size("todo") > 0)
    shared = _shared(spark, path)
    schema = StructType([d.schema["doc_id"], *_parse_datatype_string(out).fields])

    def kernel(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                rows = []
                for x in part.drop_columns(["doc_id"]).to_pylist():
                    tree, again, nodes = Tree.load(_points(x["text"]), x["sizes"], x["lengths"], x["counts"], x["sums"]), 0, 0
                    for e in x["todo"]:
                        a, b = tree.edit(shared.value, e["at"] or 0, e["remove"] or 0, _points(e["insert"] or ""))
                        again, nodes = again + a, nodes + b
                    rows.append(row(tree, x, again, nodes))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return d.where(has).mapInArrow(kernel, schema), d.where(~has)


def recount(trees: DataFrame, edits: str | Column = "edits", path: str = VOCABULARY) -> DataFrame:
    """doc_id and :data:`COUNTS` of each row of ``trees``, with the edits (of type :data:`EDITS`) that go with the row."""
    count = lambda tree, x, again, nodes: (x["tokens"], tree.total, len(x["todo"]), x["pretokens"], again, nodes)
    busy, idle = _edited(trees, edits, path, COUNTS, count)
    zero = F.lit(0).cast("long")
    idle = idle.select("doc_id", F.col("tokens").alias("tokens_before"), F.col("tokens").alias("tokens_after"), zero.alias("n_edits"), "pretokens", zero.alias("reencoded_pretokens"), zero.alias("updated_nodes"))
    return busy.unionByName(idle)


def update(trees: DataFrame, edits: str | Column = "edits", path: str = VOCABULARY) -> DataFrame:
    """``trees`` after the edits: the table to keep from then on."""
    new = lambda tree, x, again, nodes: (tree.text(), tree.total, tree.pretokens, *tree.dump())
    busy, idle = _edited(trees, edits, path, TREE, new)
    return busy.unionByName(idle.drop("todo"))


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with a column ``edits``, from a table ``edits(doc_id, seq, at, remove, insert)`` in the order of ``seq``.

    Edits of unknown or null documents are ignored.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    by = edits.groupBy(F.col("doc_id").try_cast(kind).alias("edit_doc")).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("seq", "long"), ("at", "long"), ("remove", "long"), ("insert", "string"))]))).alias("e"))
    by = by.select("edit_doc", F.transform("e", lambda x: F.struct(x["at"].alias("at"), x["remove"].alias("remove"), x["insert"].alias("insert"))).alias("edits"))
    return trees.select("doc_id", *[x.split()[0] for x in TREE.split(", ")]).join(by, F.col("doc_id") == F.col("edit_doc"), "left").drop("edit_doc")


def example_edits(text: Column, doc_id: Column) -> Column:
    """Three edits of every text, placed by a hash: a word replaced, a passage cut out, a line put in."""
    n = F.length(text).cast("long")
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1)
    e = lambda a, r, s: F.struct(a.alias("at"), F.lit(r).cast("long").alias("remove"), F.lit(s).alias("insert"))
    return F.array(e(at(1), 7, " revised it's"), e(at(2), 40, ""), e(at(3), 0, "\nSee also  the 2nd note.\n"))
