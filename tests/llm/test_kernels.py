import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import exact_topk, langid, near_dedup, quality, token_counts
from codestrata.llm.textkernel import Words, gram_mask, grams, letters, slices

TEXT = st.lists(st.text(alphabet=st.sampled_from(list("ab Zé1_.,«ß\n\t—x９😀甲，乙→ह\u0301Ⅳ𝒜")), max_size=40), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_are_runs_of_letters_and_digits(texts):
    w = Words(pa.array(texts))
    data = w.buf.tobytes()
    got = [[data[w.start[k] : w.end[k]].decode() for k in range(w.ptr[i], w.ptr[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\W_]+", t.lower()) for t in texts]


def test_lower_case_keeps_letters_letters():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    low = pc.utf8_lower(pa.array([chr(c) for c in points])).to_pylist()
    assert all(len(x) == 1 and letters()[c] == letters()[ord(x)] for c, x in zip(points, low))


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_hashes_tell_words_and_grams_apart(texts):
    w = Words(pa.array(texts))
    words = [x for t in texts for x in re.findall(r"[^\W_]+", t.lower())]
    by = {}
    for h, x in zip(w.h.tolist(), words):
        assert by.setdefault(h, x) == x
    assert len(by) == len(set(words))
    ok = gram_mask(w.ptr, len(w.h), 3)
    want = sum(max(0, len(re.findall(r"[^\W_]+", t.lower())) - 2) for t in texts)
    assert ok.sum() == want and len(grams(w.h, 3)) == len(ok)


def test_slices_cover_all_rows_and_nulls_count_as_empty():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 50, None, "b" * 500, "", "c"]})
    parts = list(slices(b, "text", 100))
    assert sum(p.num_rows for p in parts) == 5
    assert Words(pa.array([None, "x"])).counts.tolist() == [0, 1]


def test_min_max_signature_estimates_jaccard_without_bias():
    rng = random.Random(3)
    errors = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = words[: rng.randrange(60, 300)] + [f"v{rng.randrange(10**6)}" for _ in range(60)]
        a, b = ({tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (words, other))
        sig, _ = near_dedup.signatures(pa.array([" ".join(words), " ".join(other)]))
        errors.append((sig[0] == sig[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_linkage_connects_chains():
    a = np.zeros((3, 128), np.uint32)
    a[1, :50] = 1
    a[2, :100] = 1
    assert len(near_dedup._linked(a, 0.5)) == 2  # 0-1 and 1-2 are alike, 0-2 are not
    assert near_dedup._linked(a[[0, 2]], 0.5) == []


@pytest.mark.parametrize("offset, spread, dim, n", [(0, 1, 8, 300), (100, 0.01, 64, 900), (1e3, 0.1, 64, 900), (1e4, 1, 128, 900), (0, 1e20, 32, 600), (1e20, 1e15, 16, 600), (0, 1e-20, 16, 600), (5, 0, 4, 60), (0, 1, 3, 60)])
def test_two_scans_equal_brute_force_wherever_the_vectors_lie(offset, spread, dim, n):
    rng, k, step = np.random.default_rng(0), 5, 250
    x = (offset + spread * rng.normal(size=(n, dim))).astype(np.float32)
    if dim == 3:
        x = np.round(x, 1)  # many ties
    x[7] = x[3]
    ids = np.arange(n)
    grid = exact_topk.Grid(x.astype(float).min(0), x.astype(float).max(0))
    code, radius = grid.encode(x)
    q, best, found, read = exact_topk.Queries(grid, x[:200], ids[:200]), np.full((min(n, 200), k), np.inf), {}, 0
    for a in range(0, n, step):
        exact_topk.upper_bounds(q, code[a : a + step], radius[a : a + step], ids[a : a + step], best)
    for a in range(0, n, step):
        r, c, d, m = exact_topk.nearest(q, code[a : a + step], radius[a : a + step], ids[a : a + step], x[a : a + step], best[:, k - 1], k)
        read += m
        for i, j, v in zip(r.tolist(), ids[a : a + step][c].tolist(), d.tolist()):
            found.setdefault(i, []).append((v, j))
    for i in range(len(q)):
        d2 = ((x[i].astype(float) - x.astype(float)) ** 2).sum(1)
        assert sorted(found[i])[:k] == sorted((d2[j], j) for j in range(n) if j != i)[:k]
    if dim > 8:
        assert read < 40 * len(q)  # exact vectors of few are read


def test_gradients_match_finite_differences():
    net = langid.Network(["a", "b", "c"], hidden=4, seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(2)
    data, mask, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.ones((6, 5), np.float32), np.array([0, 1, 2, 1, 0])
    mask[4:, 1] = 0
    _, g = net.step(data, mask, y)
    for k in ("uf", "ub", "bf", "of", "c"):
        flat = net.p[k].ravel()
        for i in rng.integers(0, flat.size, 3):
            keep, e = flat[i], 1e-2
            flat[i] = keep + e
            up = net.step(data, mask, y)[0]
            flat[i] = keep - e
            down = net.step(data, mask, y)[0]
            flat[i] = keep
            assert abs((up - down) / (2 * e) - g[k].ravel()[i]) < 2e-3, k


def test_score_equals_a_network_run_byte_by_byte():
    net = langid.Network(["a", "b", "c"], hidden=5, seed=3)
    texts, window = ["hello world, é", "x", "", "y" * 21], 7
    p, votes, n = net.score(pa.array(texts), window)

    def states(data, d):
        x, u, bias, h = net.p["x" + d].astype(float), net.p["u" + d].astype(float), net.p["b" + d][:, 0].astype(float), np.zeros(net.h)
        out = [None] * len(data)
        for t in range(len(data)) if d == "f" else reversed(range(len(data))):
            g, q = x[:, data[t]], u @ h
            z, r = (1 / (1 + np.exp(-(g[a : a + net.h] + q[a : a + net.h]))) for a in (0, net.h))
            new = np.tanh(g[2 * net.h :] + r * (q[2 * net.h :] + bias))
            h = new + z * (h - new)
            out[t] = h
        return out

    for i, text in enumerate(texts):
        data, total, count = text.encode(), np.zeros(3), np.zeros(3, int)
        for a in range(0, len(data), window):
            own = data[a : a + window]
            for f, b in zip(states(own, "f"), states(own, "b")):
                z = net.p["of"] @ f + net.p["ob"] @ b + net.p["c"][:, 0]
                e = np.exp(z - z.max())
                total += e / e.sum()
                count[z.argmax()] += 1
        assert n[i] == len(data) and votes[i].tolist() == count.tolist()
        assert np.allclose(p[i], total / max(1, len(data)), atol=1e-5)


def test_every_position_is_labelled_once():
    net = langid.Network(["a", "b"])
    p, c, n = net.score(pa.array(["x" * 200, "", None, "é" * 40, "yz"]))
    assert c.sum(1).tolist() == n.tolist() == [200, 0, 0, 80, 2]
    assert np.allclose(p.sum(1), [1, 0, 0, 1, 1], atol=1e-5)
    alone, _, _ = net.score(pa.array(["yz"]))
    assert np.allclose(alone[0], p[4], atol=1e-6)  # a text's result doesn't depend on its neighbours


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    total = rng.integers(0, 5, 200).astype(float)
    good = np.minimum(total, rng.integers(0, 5, 200)).astype(float)
    v = quality.isotonic(total, good)
    assert (np.diff(v) >= -1e-12).all() and abs((v * total).sum() - good.sum()) < 1e-9


ALPHABET = list("ab é1２'srtvelmd  \n\t.,!😀ßñ")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(ALPHABET), max_size=60))
def test_splitter_equals_the_pattern(s):
    import regex

    assert token_counts.starts(token_counts._points(s)).tolist() == [m.start() for m in regex.finditer(token_counts.PATTERN, s)]


def test_edits_equal_a_full_recount():
    import regex

    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    rng = random.Random(5)
    for _ in range(150):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 5, 300, 1500])))
        code = token_counts._points(s)
        begin = token_counts.starts(code)
        lengths = np.diff(np.r_[begin, len(code)])
        tree = token_counts.Tree.of(code, lengths, counter.many(code, begin))
        for _ in range(5):
            tree = token_counts.Tree.load(token_counts._points(s), *tree.dump())
            at, cut = rng.randint(0, len(s)), rng.choice([0, 1, 3, 200])
            put = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 4, 300])))
            tree.edit(counter, at, cut, token_counts._points(put))
            s = s[:at] + put + s[at + cut :]
            got = np.concatenate([b for _, b, _ in tree.blocks]).tolist() if tree.blocks else []
            assert got == [m.end() - m.start() for m in regex.finditer(token_counts.PATTERN, s)]
            assert tree.text() == s and tree.levels[-1][0, 1] == len(s) and tree.pretokens == len(got)
            for low, high in zip(tree.levels, tree.levels[1:]):
                assert (np.add.reduceat(low, np.arange(0, len(low), 2), axis=0) == high).all()
            assert tree.total == len(counter.tokenizer().encode_ordinary(s))


def test_small_edits_encode_little_again():
    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    code = token_counts._points("some words of a long text " * 4000)
    begin = token_counts.starts(code)
    tree = token_counts.Tree.of(code, np.diff(np.r_[begin, len(code)]), counter.many(code, begin))
    again, nodes = tree.edit(counter, 50_000, 3, token_counts._points("new"))
    assert again < 30 and nodes < 60


def test_an_edit_of_a_few_words_sorts_nothing(monkeypatch):
    from codestrata.llm import token_counts as tc

    rng = random.Random(11)
    with open(tc.VOCABULARY, "rb") as f:
        counter = tc.Counter(f.read())
    whole = lambda text: (code := tc._points(text), b := tc.starts(code), counter.many(code, b))
    text = "".join(rng.choice(["word", " of", "it's", "  ", "\n", "12", "…", " é"]) for _ in range(1500))
    code, begin, counts = whole(text)
    tree = tc.Tree.of(code, np.diff(np.append(begin, len(code))), counts)
    with monkeypatch.context() as m:
        for name in ("unique", "isin"):
            m.setattr(np, name, lambda *_, **__: pytest.fail("sorted"))
        for k in range(200):
            at, remove, insert = rng.randrange(len(text) + 1), rng.randrange(30), rng.choice(["", " it's", "\n  x", "77", " "])
            tree.edit(counter, at, remove, tc._points(insert))
            text = text[:at] + insert + text[at + remove :]
            low, sums = tree.levels[0], np.array([(int(n.sum()), len(c)) for c, _, n in tree.blocks], np.int64)
            assert (low == sums).all() and all((np.add.reduceat(x, np.arange(0, len(x), 2), axis=0) == y).all() for x, y in zip(tree.levels, tree.levels[1:])), k
    code, begin, counts = whole(text)
    assert tree.text() == text and tree.total == counts.sum() and tree.pretokens == len(begin)
