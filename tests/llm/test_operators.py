"""The numbered operators against plain versions, on small tables with nulls, empty and long texts, ties, repeats and other columns."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import licences, mixing, neardup, packing, quality, queries, rulelist, search, sharding, textstats, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 7) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    base = " ".join(rng.choice(words) for _ in range(120))
    rows = [(1, None, "a"), (2, "", None), (3, "x", "b"), (4, base, "a"), (5, base, "a"), (5, base, "a"), (6, base.replace(base.split()[60], "zz", 1), "b"), (7, long, "é"), (8, "a b\n\na b\t c", "b"), (None, "id is null", "a"), (9, "  \n ", "b")]
    return rows


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    names = ", ".join(sorted(df.columns))
    key = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert key(map(tuple, df.select(*sorted(df.columns)).collect())) == key(con.sql(f"SELECT {names} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_statistics_of_odd_texts(spark, odd):
    for r in textstats.with_statistics(docs(spark, odd)).select("text", *"n_words word_chars n_symbols n_dup_lines n_repeat_words".split(), *textstats.RATIOS).collect():
        w = plain_words(r.text)
        c, m = collections.Counter(zip(w, w[1:], w[2:])), [0] * len(w)
        for i in range(len(w) - 2):
            if c[w[i], w[i + 1], w[i + 2]] > 1:
                m[i] = m[i + 1] = m[i + 2] = 1
        lines = [x for x in (r.text or "").split("\n") if plain_words(x)]
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), sum(m))


def labelled(spark, n=400):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(80)]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w + "###" for w in words]
        if toxic:
            words[10::20] = ["grumblewort"] * 4
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_labels_and_empty_tables(spark, odd):
    d, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    got = quality.scored(d, labels).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == truth[r.doc_id].quality for r in held)
    kept = rulelist.judged(d, labels).collect()
    assert all(r.kept == bool(truth[r.doc_id].quality) for r in kept)
    tox = toxicity.scored(d, labels)
    held = [r for r in tox.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and all((r.score >= 0.7) == bool(truth[r.doc_id].toxic) for r in held)
    assert tox.columns == [c for c in d.columns if c != "score"] + ["score"]
    strange = docs(spark, odd)
    for f in (quality.scored, rulelist.judged, toxicity.scored):
        assert f(strange, labels.limit(0)).count() == len(odd)
        assert f(strange.limit(0), labels).count() == 0
    assert quality.keep_good(strange, labels).columns == strange.columns


def test_restores_disguised_words():
    costs = np.full((toxicity.SIZE,) * 3, 9.0)
    for word in ("idiot", "loser", "stupid"):
        at = [0, 0, *(toxicity.LETTERS.index(c) + 1 for c in word), 0]
        for a, b, c in zip(at, at[1:], at[2:]):
            costs[a, b, c] = 0.1
    channel = toxicity.Channel(costs)
    for written, meant in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("l0$er", "loser"), ("$tup1d", "stupid"), ("", "")):
        assert channel.restore(written) == meant
    reader = toxicity.Reader(costs)
    assert "=idiot" in reader.features("you i d i o t")[0]
    assert reader.features("")[0] == []


def test_spread_and_foreign_letters_reach_the_features(spark):
    texts = ["idiot", "loser", "stupid", "you are no one here", "go on", "put it in the tin"]
    costs = toxicity.language_model(docs(spark, [(i, f"{t} " * 50, "s") for i, t in enumerate(texts)]))
    weights = {f: 1.0 for w in ("idiot", "loser", "stupid") for f in (f"={w}", f"^{w[:4]}")}
    reader = toxicity.Reader(costs, weights)
    idiot = ["you i d i o t!", "you i d i o t, go", "(i d i o t)", "i  d  i  o  t", "i\nd\ni\no\nt", "i/d/i/o/t", "i - d - i - o - t", "id io t", "idi ot", "idi\not!", "idi*t", "idi\u00f6t", "\u0456diot", "1d10t", "!d!0t", "i.d.i.o.t", "idiooot", "y o u i d i o t"]
    for text in idiot:
        assert "=idiot" in reader.features(text)[0], text
    for text in ("st*pid", "st\u00fcpid", "$tup1d", "stu pid", "s.tupid"):
        assert "=stupid" in reader.features(text)[0], text
    for text in ("go on", "put it in the tin", "*** ** *", "los er is two", "", "st\u00fcpf", "ipad iota"):
        assert not [f for f in reader.features(text)[0] if f in ("=idiot", "=stupid")], text


def test_fold_keeps_every_reading():
    rng = random.Random(12)
    channel = toxicity.Channel(np.random.default_rng(3).uniform(0.1, 6, (toxicity.SIZE,) * 3))
    signs = "abeiloszt01345$@!|.-_\u00e9\u00f6\u0456" + "tt"
    for _ in range(400):  # folding a token and folding what it is restored to give the same form
        token = "".join(rng.choice(signs) for _ in range(rng.randint(1, 9)))
        assert toxicity.folded(channel.restore(token).replace(" ", "")) == toxicity.folded(token), token


def test_score_equals_its_features_and_weights(spark):
    d, labels = labelled(spark, 300)
    costs = toxicity.language_model(d)
    train = toxicity.featured(d.join(labels, "doc_id").selectExpr("cast(toxic as double) AS label", "text"), costs)
    weights, sure, base = toxicity.fit(train)
    assert weights and sure and all(0.7 < p < 1 for p in sure.values())
    reader = toxicity.Reader(costs, {f: 0.0 for f in sure} | weights)
    for r in toxicity.score_texts(d.select("doc_id", "text"), costs, weights, sure, base).collect():
        found, root = reader.features(r.text or "")
        z = base + sum(weights.get(f, 0.0) for f in found) / root
        assert abs(r.score - max([1 / (1 + np.exp(-z))] + [sure[f] for f in found if f in sure])) < 1e-9
        assert set(found) == {f for f in toxicity.Reader(costs).features(r.text or "")[0] if f in weights or f in sure}


def every_reading(channel, token, breaks):
    """(cost, text) of all ways through the lattice of a token."""
    ways = [(0.0, 0, 0, "")]
    for sign in token:
        new, gap = [], sign in toxicity.GAPS
        readings = [(sign, toxicity.AS_IS if sign.isalpha() else toxicity.KEPT_SIGN)] + [(c, toxicity.LEET_COST) for c in toxicity.LEET.get(sign, "")]
        for cost, a, b, text in ways:
            for letter, price in readings:
                c = channel.place.get(letter, toxicity.OTHER)
                new.append((cost + price + channel.costs[a][b][c], b, c, text + letter))
                if text and text[-1] == letter:
                    new.append((cost + price + toxicity.AGAIN_COST, a, b, text))
            if gap:
                new.append((cost + toxicity.GAP_COST, a, b, text))
        if breaks or gap:
            new += [(cost + channel.costs[a][b][0], b, 0, text + " ") for cost, a, b, text in new if b]
        ways = new
    return [(cost + (channel.costs[a][b][0] if b else 0.0), text.strip()) for cost, a, b, text in ways]


def test_restored_text_is_the_cheapest_of_all_readings():
    rng = np.random.default_rng(7)
    channel, signs = toxicity.Channel(rng.uniform(0.1, 6, (toxicity.SIZE,) * 3)), "abil1$0.|"
    for _ in range(300):
        token, breaks = "".join(rng.choice(list(signs), rng.integers(1, 5))), bool(rng.integers(2))
        assert channel.restore(token, breaks) == min(every_reading(channel, token, breaks))[1], token


def test_score_column_equals_its_rules(spark):
    d, labels = labelled(spark, 200)
    stats = textstats.with_statistics(d.select("doc_id", "text"))
    model = quality.fit(stats.join(labels, "doc_id").selectExpr("cast(quality as double) AS label", *textstats.RATIOS))
    assert model.rules
    for r in stats.select("*", model.score().alias("got")).collect():
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(r[n] > t if up else r[n] <= t for n, up, t in rule))
        assert abs(r.got - 1 / (1 + np.exp(-z))) < 1e-9


def test_disguises_of_any_length_reach_the_features():
    costs = np.full((toxicity.SIZE,) * 3, 9.0)
    for text in ("a loser", "you idiot", "ass", "hell", "shit", "stupid"):
        at = [0, 0, *(toxicity.LETTERS.find(c) + 1 for c in text), 0]  # find gives -1 for a space: the edge
        for a, b, c in zip(at, at[1:], at[2:]):
            costs[a, b, c] = 0.1
    reader = toxicity.Reader(costs)
    forms = {"a l o s e r": "loser", "y o u i d i o t": "idiot", "a s s": "ass", "a55": "ass", "a$$": "ass", "he11": "hell", "5h1t": "shit", "$h!t": "shit"}
    forms |= {"stu" + "p" * 80 + "id": "stupid", ".".join("s" * 30 + "tupid"): "stupid", " ".join("stupid" + "d" * 70): "stupid", "s" + "-" * 70 + "tupid": "stupid", "you~idiot": "idiot"}
    for form, word in forms.items():
        assert "=" + word in reader.features(f"so {form} so"[3:-3])[0], form
    run = " ".join("youidiot" * 12)  # longer than 64 letters: its end counts, too
    assert "=stupid" in reader.features(run + " " + " ".join("stupid"))[0]


def test_feistel_is_a_permutation_and_computable(spark, odd):
    for n in (1, 2, 3, 24, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    got = sharding.shard(docs(spark, odd).select("doc_id", "size"), ["doc_id", "size"], 3).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    by = sorted((r.doc_id is not None, r.doc_id or 0, r.shard, r.slot) for r in got)
    places = sorted(sharding.place(i, len(odd), 3, 2024) for i in range(len(odd)))
    assert sorted((b[2], b[3]) for b in by) == places
    assert sharding.shard(docs(spark, []).select("doc_id", "size"), ["doc_id"], 3).count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "source", "score", "_key", "_times", "_row", "_p", "_tie", "_part", "_at", "row_no", "digest", "class_id", "a.b", "size", "n", "more", "repeats", "target"]
    rows = [(i, f"some words of text number {i} that differ {i * 7}", "s", *[float(i + k) for k in range(len(names) - 3)]) for i in range(20)]
    d = spark.createDataFrame([*rows, (3, "another text under the same id, nobody's copy", *rows[3][2:])], "doc_id long, text string, source string, " + ", ".join(f"`{n}` double" for n in names[3:]))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    key = lambda df: sorted(map(str, map(tuple, df.select(*[f"`{n}`" for n in names]).collect())))
    assert key(toxicity.keep_clean(d, labels)) == key(neardup.keep_first(d)) == key(sharding.shard(d, ["doc_id"], 3)) == key(quality.keep_good(d, labels)) == key(d)
    assert set(key(mixing.mixed_documents(d))) <= set(key(d)) and mixing.mixed_documents(d).columns == names


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u\r\n4", "small"), (5, "u5", "small"), (None, "u6", None), (7, "ü7", ""), (7, "ü7", ""), (8, "x", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a"))
    got = warc.parse_records(records).collect()
    assert len(got) == len(rows)
    types = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert types[1] == types[2] == ("revisit", 3) and types[3] == types[4] == types[5] == ("response", None)
    assert {r.page_id: r.payload_bytes for r in got}[1] == 1200
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {big, "small", "", "y" * 200_000}
    stored = spark.read.parquet(*(str(tmp_path / "a" / f"payloads-{k}") for k in ("large", "small")))
    assert stored.count() == stored.select("address").distinct().count() == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = warc.read_records(spark, str(tmp_path / "a"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange") == 2  # only small payloads are shuffled
    first = next(bytes(r.record) for r in records.collect() if b"page:8:" in r.record)
    head, _, rest = first.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and rest == b"y" * 200_000 + b"\r\n\r\n"
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.parse_records(warc.read_records(spark, str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("kind", ["large", "small"])
def test_damaged_payload_stops_the_read(spark, tmp_path, kind):
    pages = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "x" * 5000), (3, "u", "small")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    place = str(tmp_path / "a" / f"payloads-{kind}")
    other = spark.read.parquet(place).selectExpr("address", "encode(translate(decode(payload, 'UTF-8'), 'xs', 'yt'), 'UTF-8') AS payload").collect()
    damaged = spark.createDataFrame(other, "address string, payload binary")
    if kind == "large":
        warc._clustered(damaged.coalesce(1), str(tmp_path / "new"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    else:
        damaged.write.parquet(str(tmp_path / "new"))
    (tmp_path / "a" / f"payloads-{kind}").rename(tmp_path / "old")
    (tmp_path / "new").rename(place)
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_records(spark, str(tmp_path / "a")).collect()


def test_header_lines_end_with_cr_lf_only(spark, tmp_path):
    urls = ["http://x/\u0105WARC-Payload-Digest: sha1:0", "http://x/\u0085WARC-Type: revisit", "\u2028WARC-Record-ID: <urn:x-page:9:9>", "\rWARC-Type: x\nContent-Length: 1", "\u0085\u0085", "", None, "a\u00c3"]
    for text in ("small \u0105\u0085", "WARC-Type: revisit\r\n\r\n" * 100):
        pages = spark.createDataFrame([(i, u, text) for i, u in enumerate(urls)], "page_id long, url string, html string")
        path = str(tmp_path / str(len(text)))
        warc.write_archive(pages, path)
        got = {r.page_id: (r.url, r.payload_bytes, r.record_type) for r in warc.parse_records(warc.read_records(spark, path)).collect()}
        kinds = ["response"] * 8 if len(text) < 1000 else ["revisit"] * 7 + ["response"]
        assert got == {i: (u.replace("\r", "%0D").replace("\n", "%0A") if u else u, len(text.encode()), kinds[i]) for i, u in enumerate(urls)}


def test_archive_of_repeated_page_ids_equals_its_sql(spark, tmp_path):
    html = ["z" * 1500, "z" * 1500, "z" * 1500, "y" * 1200, "y" * 1200, None, ""]
    pages = spark.createDataFrame([(i, "u", h) for i, h in zip([5, 5, 4, None, None, 5, 5], html)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = warc.op4_warc_archive(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(warc.OP4_SQL).fetchall()))


def shingled(text):
    w = plain_words(text)
    return collections.Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_signatures_estimate_weighted_jaccard():
    texts = ["a b c d e f g a b c d e", "", "x", None, "a b", "y" * 100 + " b c d e f", "  lead \n"]
    at, _, weight = neardup.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(weight[at == i].tolist()) == sorted(shingled(t).values())
    a, b = {k: k % 7 + 1 for k in range(60)}, {k: (k * 3) % 7 + 1 for k in range(10, 70)}
    ids = neardup._mix(np.array([*a, *b], "uint64") + np.uint64(99))
    s = neardup.bag_min_hash(np.array([0] * 60 + [1] * 60), ids, np.array([*a.values(), *b.values()]), 2, 8000)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(70)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(70))
    assert abs((s[0] == s[1]).mean() - true) < 0.025


def test_near_duplicates_equal_all_pairs(spark, odd):
    rng = random.Random(5)
    rows, vocab = [r for r in odd if r[0] is not None], [f"w{i}" for i in range(300)]
    for g in range(8):  # groups of near copies, some below the threshold
        base = [rng.choice(vocab) for _ in range(100)]
        for _ in range(8):
            copy = list(base)
            for i in rng.sample(range(100), rng.randint(0, 6)):
                copy[i] = rng.choice(vocab)
            rows.append((100 + len(rows), " ".join(copy), "s"))
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs(spark, [*rows, (None, "x", "s")])).collect()}
    assert (None, None) in got
    root = {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [(i, t or "", shingled(t)) for i, t, _ in rows]
    for (i, s, x), (j, t, y) in itertools.combinations(bags, 2):
        if s == t or (x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values())):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert got - {(None, None)} == {(i, find(i)) for i in root}
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    kept = neardup.keep_first(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in root}) and kept.columns == docs(spark, []).columns


def test_rare_keys_and_their_bound_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    vocab, passage = [f"w{i}" for i in range(40)], [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(60):  # own words around a common passage: most pairs are under the threshold, some are not
        own = [rng.choice(vocab) for _ in range(rng.randint(2, 16))]
        rows.append((len(rows), " ".join(own + passage), "s"))
        rows.append((len(rows), " ".join(own + passage[: rng.randint(50, 60)]), "s"))
    bags = {i: shingled(t) for i, t, _ in rows}
    near = {(i, j) for i, j in itertools.combinations(bags, 2) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    keys = collections.defaultdict(dict)
    for r in neardup.rare_keys(docs(spark, rows).selectExpr("doc_id as node", "doc_id as root", "text")).collect():
        keys[r.node][r.key] = (r.n, r.i)
    for i, j in near:
        (n, _), (m, _) = next(iter(keys[i].values())), next(iter(keys[j].values()))
        assert any(min(n - keys[i][k][1], m - keys[j][k][1]) >= 0.8 / 1.8 * (n + m) - 1e-9 for k in keys[i].keys() & keys[j].keys())
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    monkeypatch.setattr(neardup, "PAIRS", 0)  # deals dense buckets anew on few rows, too
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(i, find(i)) for i in root}


def ends(monkeypatch, most=150):
    """Fails instead of running for ever: a job may write so many tables."""
    count, plain = itertools.count(1), neardup.written

    def limited(df, name):
        assert next(count) <= most, "too many rounds"
        return plain(df, name)

    monkeypatch.setattr(neardup, "written", limited)


def test_texts_around_one_long_passage_come_to_an_end(spark, monkeypatch):
    ends(monkeypatch)
    passage = " ".join(f"p{i}" for i in range(84))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(16)) + " " + passage, "s") for i in range(600)]  # 80 of 96 shingles shared: 0.71
    rows += [(600, rows[7][1] + " end", "s"), (601, rows[7][1] + " end of it", "s")]
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(i, i if i < 600 else 7) for i in range(602)}


def test_slices_of_hot_buckets_lose_no_pair(spark, monkeypatch):
    ends(monkeypatch)
    rng = random.Random(9)
    phrases = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcdefgh"]
    rows = []
    for _ in range(40):  # every phrase is common, so no key is rare; most pairs pass the bound and are under the threshold
        own = " ".join(f"x{len(rows)}y{i}" for i in range(rng.randint(0, 4)))
        rows.append((len(rows), " ".join([p for p in phrases if rng.random() < 0.8] + [own]), "s"))
    bags = {i: shingled(t) for i, t, _ in rows}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(bags, 2):
        if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    monkeypatch.setattr(neardup, "PAIRS", 0)
    monkeypatch.setattr(neardup, "PAIRS_DEALT", 2)
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert 1 < len({c for _, c in got}) < len(rows) and got == {(i, find(i)) for i in root}


def test_packing_is_whole_and_tight(spark, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [r for r in odd if r[0] is not None] + [(50, "<|endoftext|> a  b\n\n c", "s"), (51, "é̂ 中文 123 ' don't", "s")]
    got = packing.pack(packing.tokenised(docs(spark, rows), capacity=256, added=packing.ADDED), capacity=256).collect()
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows}
    by = collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length
        assert r.piece == 0 or r.length == 256
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(len(ids[i]) for i, _, _ in rows)
    assert sum(r.length for r in got) == total and len(by) <= -(-total // 256) + 1
    assert packing.pack(packing.tokenised(docs(spark, []))).count() == 0


def test_packed_ids_are_those_of_tokenizers_by_default(spark, tmp_path):
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact, end = Tokenizer.from_file(path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [end, f"a {end} b", f"  {end}x{end}{end}\n", "<|endoftext| > é", f"{end} a  b\n\n c", f"a <{end}> {end.upper()}", "", None]
    texts.append(f"word {end} " * 1500)
    texts += [" " * 2_000_000, "a" * 2_000_000, "a" + "\n" * 30_000 + " b", f"x{end}" + "=-" * 20_000]  # runs that the fast way can't take
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for i, t, _ in rows}
    for packed in (packing.op6_packed_sequences(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs(spark, rows), "")):
        got = packed.collect()
        for r in got:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert sum(r.length for r in got) == sum(map(len, ids.values()))


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = collections.Counter(min(2048, 1 + int(rng.expovariate(1 / 500))) for _ in range(3000))
    rows, n = packing.plan(histogram)
    load, seen = collections.Counter(), collections.Counter()
    for length, a, b, s, o in sorted(rows, key=lambda r: r[4]):
        seen[length] += b - a
        for k in range(s, s + b - a):
            assert load[k] == o
            load[k] += length
    assert seen == histogram and max(load.values()) <= 2048 and len(load) == n
    assert n <= 1.01 * sum(k * v for k, v in histogram.items()) / 2048 + 1


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "WAVE", 5)  # several waves
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)] + [(500, None), (501, [1.0, None]), (550, [float("nan")] * 8), (551, [float("inf")] * 8), (600, [1e30] * 8), (601, []), (700, []), (700, []), (650, [3e5, 1.0]), (651, [-1e300, 2.0]), (652, [1e200, 5e17])]
    rows += [(300, [1.0] * 8), (301, [1.0] * 8), (301, [1.0] * 8), (50, [2.0] * 8), (100, rows[100][1]), (100, rows[100][1])]  # repeated ids and rows
    v = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.Counter(map(tuple, search.top_k(v, v.where("vec_id % 50 = 0")).collect()))
    ints = [(r.vec_id, [int(x) for x in r.v]) for r in v.collect()]
    assert dict(ints)[651][0] == -256 * int(1e300) and {600, 601, 700} <= set(dict(ints)) and not {500, 501, 550, 551} & set(dict(ints))
    big, want = 1 << 63, collections.Counter()
    for row, (q, w) in enumerate(ints):
        if q % 50 == 0:
            pairs = [(-max(-big, min(big - 1, sum(a * b for a, b in zip(w, x)))), i) for other, (i, x) in enumerate(ints) if other != row and len(x) == len(w)]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(pairs)[:5]))
    assert got == want
    assert search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_scan_holds_no_more_than_its_bound(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.floor(256 * (1 + 1e-3 * rng.normal(size=(100_000, 4))))  # nearly equal: most fall into the same few cells
    edges = np.quantile(x, np.arange(9) / 8, axis=0, method="nearest")
    low, high = edges[:-1], edges[1:]
    codes = np.stack([np.searchsorted(low[1:, i], x[:, i], side="right") for i in range(4)], 1).astype("uint8")
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), pa.array([c.tobytes() for c in codes[a : a + 10_000]], pa.binary())], ["no", "code"]) for a in range(0, 100_000, 10_000)]
    sent = type("Sent", (), {"value": (x[:40], np.arange(40), low, high)})
    whole = [b.num_rows for b in search._scan(sent, 6)(iter(batches))]
    monkeypatch.setattr(search, "HELD", 20_000)
    parts = list(search._scan(sent, 6)(iter(batches)))
    assert sum(whole) > 40 * 6 and max(b.num_rows for b in parts) <= 20_000 + 40 * search.CHUNK
    found = {(q, n) for b in parts for q, n in zip(b["q"].to_pylist(), b["no"].to_pylist())}
    exact = x[:40] @ x.T
    for q in range(40):
        for n in np.lexsort((np.arange(100_000), -exact[q]))[:5]:
            sixth = np.sort(exact[q])[-6]
            assert (q, int(n)) in found or exact[q, n] <= sixth


def test_equal_vectors_in_great_number(spark):
    v = search.quantised(spark.range(100_000).selectExpr("id + 1 as vec_id", "array(1f, 2f) as embedding"))
    got = search.top_k(v, v.where("vec_id % 20000 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(q, k, k) for q in range(20_000, 100_001, 20_000) for k in range(1, 6)]


def test_approximations_bound_scores_and_save_exact_reads(spark):
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(2000, 16)))
    vectors = spark.createDataFrame([(i, i, row.tolist()) for i, row in enumerate(x)], "no long, vec_id long, v array<double>")
    low, high = search.marks(vectors, 16, 32)
    file = search.approximated(vectors, low).orderBy("no").collect()
    codes = np.frombuffer(b"".join(r.code for r in file), "uint8").reshape(2000, 16)
    lower, upper = search.bounds(x[:40], low, high, codes)
    exact = x[:40] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    found = search.candidates(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("no", "q"), 16, 5)
    assert 40 * 5 <= found.count() < 40 * 40  # of 40 * 1999


def test_mix_meets_targets(spark, odd):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(int(rng.expovariate(1 / 50)))), rng.choice(["a", "b", "c", None])) for i in range(600)]
    d = docs(spark, rows).withColumn("size", mixing.word_count("text"))
    got = mixing.mix(d).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()))
    source = {i: s for i, _, s in rows}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.size * r.repeats
        target[s] = r.target
        assert r.repeats <= 3
    want, left = {}, dict(zip(sorted(s for s in sizes if s) + [None], itertools.cycle((1, 2, 3))))
    while True:
        level = (sum(sizes.values()) - sum(want.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > 3 * sizes[s]]
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    want |= {s: w * level for s, w in left.items()}
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 5
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 0.002 * sum(sizes.values())
    assert mixing.mix(docs(spark, odd)).count() == len(odd)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, odd)).columns == docs(spark, odd).columns


@pytest.mark.parametrize("fraction", [0.005, 0.3, 0.5, 0.97, 0.995])
def test_choice_ends_near_what_is_owed(fraction):
    import pandas as pd

    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(20, 80))
        size = np.sort((rng.exponential(300, n) + 5).astype("int64"))
        group = pd.DataFrame({"source": "a", "doc_id": np.arange(n), "size": size, "digest": 0, "n": rng.integers(1, 3, n), "source_size": 0, "target": 0.0, "whole": 1, "fraction": fraction, "u": rng.random(n)})
        got = mixing._choose(group.sample(frac=1, random_state=2))
        owed = fraction * (group["size"] * group["n"]).sum()
        assert ((got["more"] >= 0) & (got["more"] <= got["n"])).all() and abs((got["more"] * got["size"]).sum() - owed) <= max(20, 0.02 * owed, size[:4].max())


def test_mix_splits_a_repeated_id(spark):
    rows = spark.range(1_000_000).selectExpr("if(id % 10 < 9, 7L, id) as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "if(id % 10 < 9, 3L, id % 50) as size")
    rows = rows.unionByName(spark.range(1000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as source", "5L as size"))
    got = mixing.mix(rows)
    for r in got.groupBy("source_size", "target").agg({"size": "sum", "*": "count"}).withColumnRenamed("sum(size)", "n").join(got.selectExpr("source_size", "size * repeats as taken").groupBy("source_size").sum("taken"), "source_size").collect():
        assert r.n == r.source_size and abs(r["sum(taken)"] - r.target) <= 1e-4 * r.target + 5
    assert got.count() == 1_001_000 and got.where("doc_id = 7").select("source_size", "repeats").distinct().count() == 4


def test_mixed_documents_goes_by_source_id_and_text(spark):
    one = "w " * 50
    rows = [(1, one, "s1")] + [(1, one, "s2")] + [(i, "v " * 50, "s2") for i in range(2, 40)] + [(None, one, "s1"), (None, "u " * 10, "s3"), (1, one, "s1"), (1, one, "s1")]
    d = docs(spark, rows)

    keyed = d.select("source", "doc_id", mixing.word_count("text").alias("size"), mixing.F.xxhash64("text").alias("digest"), "text")
    times = collections.Counter()
    for r in mixing.repeated(keyed).collect():
        times[r.source, r.doc_id, r.text] += r.repeats
    got = collections.Counter((r.source, r.doc_id, r.text) for r in mixing.mixed_documents(d).collect())
    assert got == +times and times["s1", 1, one] <= 9


def test_licences_of_odd_texts(spark, odd):
    mit = licences.TEMPLATES["mit"].split()
    wrapped = "Copyright 2020 A\n\n" + "\n".join(" * " + " ".join(mit[i : i + 9]) for i in range(0, len(mit), 9)) + "\n\nint main() {}"
    rows = [*odd, (20, "x\nReleased under the MIT license!\ny", "s"), (21, "licensed under CC BY 4.0", "s"), (22, "released to nobody under the law", "s"), (23, wrapped, "s")]
    rows += [(24, "As said, this text is\nlicensed under\nCC BY-NC 4.0, like others.", "s"), (25, licences.TEMPLATES["gpl-3.0-header"].replace("useful", "of use"), "s"), (26, licences.TEMPLATES["bsd-3-clause"][:300], "s")]
    rows += [(20, "Released under the MIT license", "s")]
    got = collections.defaultdict(dict)
    for r in licences.scan(docs(spark, rows)).collect():
        got[r.doc_id][r.licence] = (r.dice, r.first_word, r.n_windows)
    assert {i: set(v) for i, v in got.items()} == {20: {"mit-notice"}, 21: {"cc-by-4.0-notice"}, 23: {"mit", "mit-permission"}, 24: {"cc-by-nc-4.0-notice"}, 25: {"gpl-3.0-header"}, 26: {"bsd-conditions"}}
    assert got[20]["mit-notice"] == (1.0, 0, 3) and got[24]["cc-by-nc-4.0-notice"][:2] == (1.0, 5) and got[23]["mit"][0] == 1.0
    assert licences.scan(docs(spark, [])).count() == 0


def test_licence_windows_equal_all_windows():
    rng, known = random.Random(11), licences.Templates({"a": "p q r p q s", "b": "q r"}, 0.7)
    for _ in range(200):
        w = [rng.choice("pqrsx") for _ in range(rng.randint(0, 14))]
        want = {}
        for name, t in (("a", "p q r p q s".split()), ("b", ["q", "r"])):
            own, m = collections.Counter(zip(t, t[1:])), len(t) - 1
            pairs = list(zip(w, w[1:]))
            every = [(2 * sum((collections.Counter(pairs[i : i + m]) & own).values()) / (len(pairs[i : i + m]) + m), -i) for i in range(len(pairs)) if pairs[i] in own]
            if every and max(every)[0] >= 0.7:
                want[name] = (max(every)[0], -max(every)[1], sum(d >= 0.7 for d, _ in every))
        assert {n: rest for n, *rest in known.scan(" ".join(w))} == {k: list(v) for k, v in want.items()}
