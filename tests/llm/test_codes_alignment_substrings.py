"""Operators 11 to 13 against plain versions: ties, nulls, repeated rows, empty tables, long texts, other columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lumenfold.llm import alignment, substrings, vectorcodes

DOCS = "doc_id long, text string, part string, n_words long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_repeats(rows, k):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words_of(text)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        edges = np.flatnonzero(np.diff([0, *map(int, gone), 0])).tolist()
        out.append((i, len(w), sum(gone), list(zip(edges[::2], edges[1::2])), kept))
    return sorted(map(str, out))


def found_repeats(df):
    return sorted(str((r.doc_id, r.n_words, r.n_removed, [(s["start"], s["end"]) for s in r.spans], r.kept)) for r in df.collect())


def test_repeats_equal_a_plain_scan(spark):
    rng = random.Random(3)
    pool = [[rng.choice("abc") for _ in range(rng.randint(4, 30))] for _ in range(6)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(w for _ in range(rng.randint(0, 4)) for w in rng.choice(pool))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "x y\u0085z " * 30), (104, "long " * 9000), (-5, rows[3][1]), (None, rows[4][1]), (105, "w" * 200_000 + " b"), (106, rows[3][1] + " tail")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    for k, size in ((5, 1 << 30), (20, 2000), (1, 1 << 20)):
        assert found_repeats(substrings.repeats(df, k, size)) == plain_repeats(rows, k)


def test_repeats_of_rows_with_one_id_and_of_none(spark):
    text = " ".join(map(str, range(40)))
    found = substrings.repeats(spark.createDataFrame([(1, text, "", 0)] * 50 + [(None, text, "", 0)] * 3, DOCS)).collect()
    assert sorted(r.n_removed for r in found) == [0] + [40] * 52
    assert substrings.repeats(spark.createDataFrame([], DOCS)).collect() == []
    pair = substrings.repeats(spark.createDataFrame([(1, text, "", 0), (1, text + " x", "", 0)], DOCS)).collect()  # one order of the two, whatever it is
    assert sorted(r.n_removed for r in pair) in ([0, 40], [0, 40])


def test_window_hashes_are_polynomials():
    rng = np.random.default_rng(1)
    d = rng.integers(0, 1 << 63, 50).astype("uint64")
    base = substrings.BASES[0]
    for k in (1, 2, 3, 7, 20, 50):
        want = [sum(int(x) * pow(base, k - 1 - i, 1 << 64) for i, x in enumerate(d[s : s + k])) % (1 << 64) for s in range(len(d) - k + 1)]
        assert substrings.polynomials(d, k, base).tolist() == want
    assert len(substrings.polynomials(d[:3], 4, base)) == 0


@pytest.mark.parametrize("size", [1, 2, 17, 400])
def test_slices_of_a_text_hold_its_words(monkeypatch, size):
    texts = ["a bb  ccc\n\td" * 20, None, "", " ", "x" * 100 + " y", "é\u0085 z\x0b\x0c "]
    want = substrings.word_digests(texts)
    monkeypatch.setattr(substrings, "SLICE_BYTES", size)
    counts, digests = substrings.word_digests(texts)
    assert counts.tolist() == want[0].tolist() == [len(words_of(t)) for t in texts]
    assert all(x.tolist() == y.tolist() for x, y in zip(digests, want[1]))
    assert [w for s in substrings._slices(texts[0].encode()) for w in s.split()] == texts[0].encode().split()


def test_parts_are_read_without_another_shuffle(spark):
    df = spark.createDataFrame([(i, f"a b {i}", "", 0) for i in range(30)], DOCS)
    plan = substrings.repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the replies


def test_orchard_search_equals_a_full_search_and_skips_entries():
    rng = np.random.default_rng(2)
    for trial in range(60):
        k, d, spread = int(rng.integers(1, 17)), int(rng.integers(1, 5)), int(rng.choice([1, 3, 50, 4000]))
        entries, values = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread, spread + 1, (200, d))
        full = ((values[:, None] - entries[None]) ** 2).sum(2)
        best, least, done = vectorcodes.nearest(values, entries, *vectorcodes.neighbour_lists(entries))
        assert best.tolist() == full.argmin(1).tolist() and least.tolist() == full.min(1).tolist()
        assert done <= 200 * k
    entries = np.arange(16)[:, None] * 1000
    values = entries.repeat(50, 0) + rng.integers(-3, 4, (800, 1))
    assert vectorcodes.nearest(values, entries, *vectorcodes.neighbour_lists(entries))[2] < 800 * 16 * 0.7


def plain_codes(rows):
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    dim = len(min(kept, key=lambda r: (r[0] is None, r[0] or 0))[1])
    kept = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0))
    w = dim // 8
    part = lambda v, p: v[p * w : p * w + w]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda v, b: min((sum((x - y) ** 2 for x, y in zip(v, e)), i) for i, e in enumerate(b))
    for _ in range(6):
        for p in range(8):
            of = collections.defaultdict(list)
            for _, v, _ in kept:
                of[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else books[p][e] for e in range(len(books[p]))]
    out = [(i, "".join(f"{near(part(v, p), books[p])[1]:02x}" for p in range(8)), sum(near(part(v, p), books[p])[0] for p in range(8)), lab) for i, v, lab in kept]
    total = collections.Counter()
    for _, _, e, lab in out:
        total[lab] += e
    text = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(str((i, c, e, total[lab], hashlib.sha256(text.encode()).hexdigest())) for i, c, e, lab in out)


@pytest.mark.parametrize("scale,n", [(1.0, 70), (1.0, 5), (3e4, 30)])
def test_codes_equal_plain_quantisation(spark, scale, n):
    rng = random.Random(4)
    value = lambda: rng.choice([rng.uniform(-1, 1), -0.25, 0.0]) * scale
    rows = [(i, [value() for _ in range(16)], rng.choice([None, 1, 2])) for i in rng.sample(range(-20, 200), n)]
    rows += [(500, rows[0][1], 1), (501, rows[0][1], None), (None, rows[1][1], 2), (502, None, 1), (503, [None] + [0.0] * 15, 1), (504, [float("nan")] * 16, 1), (505, [float("inf")] * 16, None), (506, [], 1), (507, [1.0] * 8, 1)]
    df = spark.createDataFrame([(i, v, lab, "z") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    found, books = vectorcodes.compressed(df)
    got = sorted(str((r.vec_id, r.code, r.error, r.label_error, vectorcodes.digest(books))) for r in found.collect())
    assert got == plain_codes(rows)
    some = found.first()
    of = next(v for i, v, _ in rows if i == some.vec_id)
    assert sum((int(np.floor(4096 * x)) - y) ** 2 for x, y in zip(of, vectorcodes.decoded(some.code, books))) == some.error


def test_codes_of_huge_components_and_of_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    found, _ = vectorcodes.compressed(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.5] * 8, 1)], schema))
    assert {r.vec_id: (r.code, r.error) for r in found.collect()} == {1: ("00" * 8, 0), 2: ("01" * 8, 0), 3: ("02" * 8, 0)}
    found, books = vectorcodes.compressed(spark.createDataFrame([(1, None, 1)], schema))
    assert found.collect() == [] and vectorcodes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert vectorcodes.compressed(spark.createDataFrame([(1, [0.5] * 9, 1)], schema))[0].collect() == []


def test_merge_pieces_of_any_size_give_the_same_groups():
    rng = np.random.default_rng(5)
    for trial in range(150):
        end = int(rng.integers(1, 80))
        a, b = (np.unique(np.r_[rng.integers(1, end + 1, rng.integers(0, end)), end]) for _ in range(2))
        common = np.intersect1d(a, b)
        for piece in (1, 2, 3, 7, 64, 1000):
            of_a, of_b, n = alignment.groups(a, b, piece)
            assert n == len(common) and of_a.tolist() == np.searchsorted(common, a).tolist() and of_b.tolist() == np.searchsorted(common, b).tolist()
            i, j = alignment.diagonals(a, b, piece)
            assert (np.diff(i + j)[:-1] == piece).all() and i[-1] == len(a) and j[-1] == len(b)
            merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
            for x, y in zip(i.tolist(), j.tolist()):
                assert sum(s == 0 for _, s in merged[: x + y]) == x


def _tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def plain_links(rows):
    a_model, b_model = _tokenizers()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
    byte_of = {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in plain)}
    name_of = {i: t for t, i in a_model.get_vocab().items()}
    held, docs = collections.Counter(), []
    for i, text in rows:
        found = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            raw_a = [bytes(byte_of[c] for c in name_of[x]) for x in a]
            pieces = [b_model.id_to_piece(x) for x in b]
            raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                last = 0
                for cut in sorted({*ends_a} & {*ends_b}):
                    found.append(([x for x, e in zip(a, ends_a) if last < e <= cut], [x for x, e in zip(b, ends_b) if last < e <= cut]))
                    last = cut
        held.update({(x, y) for p, q in found for x in p for y in q})
        docs.append((i, found))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, found in docs:
        links = [(x, y) for p, q in found for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found)
        out.append((i, sum(len(p) for p, _ in found), sum(len(q) for _, q in found), len(found), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if found else "", text))
    return out


def odd_texts():
    rng = random.Random(6)
    signs = "ab  \n\t é漢\U0001f600'.!12▁\x00\x1ć \u0085"
    odd = ["", None, " ", "  ", "a ", " a", "a  b", "\n", "a\n b", "a\n  b \n", "<|endoftext|> x", "<s> </s>", "x▁y", "aaaa" * 1200, "é" * 50, "\x00", "́ ́a", "  " * 5500 + "x", "don't 's 're", "ﬁ ½ Å", "the cat sat"]
    return odd + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 50))) for _ in range(150)] + ["the cat sat"] * 3


@pytest.mark.parametrize("cut", [True, False])
def test_pairs_within_any_limits(monkeypatch, cut):
    texts = odd_texts()
    chunks = alignment._Chunks(None, None, None)
    assert chunks.cut
    chunks.cut = cut
    want = plain_links(list(enumerate(texts)))
    for wide, block in ((4096, 1 << 21), (2, 40), (0, 1), (9, 100)):
        monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
        monkeypatch.setattr(alignment, "BLOCK", block)
        x = alignment.Aligned(texts, chunks)
        assert list(zip(x.n_a.tolist(), x.n_b.tolist(), x.n_groups.tolist(), x.n_links.tolist())) == [r[1:5] for r in want]
        text, pair, times = x.pairs(32000)
        found = list(zip(text.tolist(), pair.tolist()))
        assert found == sorted(set(found)) and np.bincount(text, times, len(texts)).tolist() == [r[4] for r in want]
        links = collections.Counter((i, int(p) * 32000 + int(q)) for i, r in enumerate(want) for g in filter(None, r[8].split(";")) for p in g.split("|")[0].split(",") for q in g.split("|")[1].split(","))
        assert dict(zip(found, times.tolist())) == links


def test_links_equal_a_plain_count(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (7, "one id twice"), (7, "one id twice")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    want = plain_links(rows)
    assert sorted(map(str, (tuple(r) for r in alignment.linked(df).collect()))) == sorted(str(r[:8]) for r in want)
    assert sorted(map(str, (tuple(r) for r in alignment.alignments(df).collect()))) == sorted(str((*r[:5], r[8])) for r in want)


def test_links_of_an_empty_table_and_of_texts_without_tokens(spark):
    assert alignment.linked(spark.createDataFrame([], DOCS)).collect() == []
    found = alignment.linked(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], DOCS)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
