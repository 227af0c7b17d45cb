"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovel.llm import common, langid, lz_print, mixing, packing, quality, simhash, tokens, toxicity, url_filter, warc

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
random.seed(5)
VOCAB = ["alpha", "Beta,", "gamma", "delta.", "été", "naïve", "x", "42", "l'art", "don't", "ßtraße", "—", "日本語", "…"]
LONG = " ".join(random.choice(VOCAB) + str(i % 7) for i in range(6000))
TEXTS = [None, "", " ", "one", "a  b", "end ", "\n\nx\n", "▁odd ▁", "<|endoftext|> s </s>", "tab\tnbsp x y", "A\x1cB", "É́ combining", "1.5, 2.5.", "same text here", "same text here", LONG, *[" ".join(random.choices(VOCAB, k=random.randint(1, 80))) for _ in range(30)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", len(t or ""), 1.0, "k") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "src0", 3, 1.0, "k"), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string").repartition(3)


def test_tokens(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    own, lib = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = defaultdict(list)
    for r in tokens.token_pieces(docs, WORD, max_len=64).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, array("I", r.ids).tolist()))
    for i, t in enumerate(TEXTS):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k // 64, k, len(ids[k : k + 64]), ids[k : k + 64]) for k in range(0, len(ids), 64)]
        assert sorted(got[i]) == sorted(want * (2 if i == 3 else 1)), t
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, PIECE).collect()}
    assert all(counts[i] == (len((t or "").encode()), len(lib.encode(t or ""))) for i, t in enumerate(TEXTS))
    assert tokens.token_counts(docs.limit(0), PIECE).count() == 0 and tokens.token_pieces(docs.limit(0), WORD, max_len=8).count() == 0


def test_best_fit_by_hand():
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 3, 4, 9, 8, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0)]
    fit = packing.BestFit(10, 2)
    assert [fit.put(n) for n in (5, 8, 6, 2)] == [(0, 0), (1, 0), (2, 0), (2, 6)] and sorted(fit.left()) == [(0, 5), (2, 8)]
    with pytest.raises(ValueError):
        fit.put(11)


@pytest.mark.parametrize("group_rows", [40, 100_000])
def test_pack(spark, monkeypatch, group_rows):
    monkeypatch.setattr(packing, "GROUP_ROWS", group_rows)
    rows = [(i, 0, random.randint(1, 100)) for i in range(500)] + [(7, 0, 50)] * 3
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), ["doc_id", "piece"], capacity=100, most_open=16, about_rows=500).collect()
    assert Counter((r.doc_id, r.length) for r in found) == Counter((i, n) for i, _, n in rows)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 100
    assert len(bins) < 1.15 * sum(n for *_, n in rows) / 100 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, piece int, length long"), ["doc_id", "piece"], about_rows=0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a.B.org/x?q=1", big), (2, "http://a.b.org/x?q=1", big), (9, None, big), (3, "https://c.com", "short"), (4, "https://c.com", "short"), (6, "no scheme \n odd", None), (7, "http://d/ä#f", ""), (2, "http://a.b.org/x?q=1", big), (None, "http://e", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")).repartition(3)
    folder = f"file://{tmp_path}/w"
    captures = warc.write_archives(pages, folder)
    ranges = warc.write_index(captures, folder)
    found = warc.read_records(captures.select("key").distinct(), folder, ranges, payload=True).collect()
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((j for j, _, k in rows if k == h and j is not None), default=None) if len(raw) >= 100 else None
        back = first if first is not None and i != first else None
        want[(i, "response" if back is None else "revisit", back, len(raw), hashlib.sha256(raw).hexdigest(), None if back else raw)] += 1
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in found) == want
    reader = warc.Reader(folder, ranges)
    assert [r["page_id"] for r in reader.find(warc.surt("https://c.com", 3))] == [3] and reader.find(warc.surt("https://c.com", 99)) == []
    assert warc.archive_and_read(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_index_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.createDataFrame([(i // 2, f"http://h{i // 2 % 7}.org/{i // 2}", f"page {i}") for i in range(120)], "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    captures = warc.write_archives(pages, folder)
    reader = warc.Reader(folder, warc.write_index(captures, folder))
    for i in range(60):
        assert sorted(r["payload"].decode() for r in reader.find(warc.surt(f"http://h{i % 7}.org/{i}", i))) == [f"page {2 * i}", f"page {2 * i + 1}"]


def test_lz_prints(spark, docs):
    nulls = [(None, r.text) for r in docs.sparkSession.createDataFrame([("no id",), ("no id either",)], "text string").orderBy(F.xxhash64("text").desc()).collect()]
    docs = docs.unionByName(docs.where("doc_id IS NULL").withColumn("text", F.lit("no id either")))
    for rows in (1, 3, 1000):
        found = lz_print.edited_likeness(docs, range_rows=rows).collect()
        order = sorted([(i, t) for i, t in enumerate(TEXTS)] + [(3, "one")], key=lambda x: -x[0]) + nulls
        assert len(found) == len(order)
        want = Counter()
        for k, (i, t) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            a, b, c = map(lz_print.print_of, (t, edited, after))
            want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz_print.show(a), lz_print.show(b), lz_print.likeness(a, b), lz_print.likeness(a, c))] += 1
        assert Counter(map(tuple, found)) == want
    assert lz_print.edited_likeness(docs.limit(0)).count() == 0


def test_lz_phrases_are_lz78():
    import xxhash

    for t in TEXTS:
        parts, seen, at = lz_print.symbols(t or ""), set(), ()
        assert "".join(parts) == "".join((t or "").split()) and max(map(len, parts), default=0) <= 8
        for s in parts:
            at += (s,)
            if at not in seen:
                seen.add(at)
                at = ()
        assert len(lz_print.Parse().feed(parts, xxhash.xxh64_intdigest).hashes) == len(seen)


def test_language(spark):
    train = spark.createDataFrame([(i, t, x) for i in range(20) for t, x in (("the house of the king and the queen", "en"), ("la maison de la reine et du roi", "fr"), ("das haus der königin und des königs", "de"))] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit_text(train)
    pages = spark.createDataFrame([(1, "http://a.fr/x", '<html lang="fr"><p>la maison du roi</p>'), (2, "http://a.fr/y", "<p></p>"), (3, None, None), (4, "http://b.de", '<html lang="de"><script>the the</script>das haus der königin'), (4, "http://b.de", ""), (None, "junk", "the king")], "page_id long, url string, html string").withColumn("ll", F.lit(1))
    found = defaultdict(list)
    for r in langid.identify(pages, model).collect():
        found[r.page_id].append(r)
    assert found[1][0].language == "fr" and found[4][0].language == "de" and found[None][0].language == "en"
    assert found[2][0].language == "fr"  # its host's prior alone
    assert all(0 < r.posterior <= 1 for rs in found.values() for r in rs) and len(found[4]) == 2
    assert langid.identify(pages.limit(0), model).count() == 0
    none = langid.fit_text(train.limit(0))
    assert {r.language for r in langid.identify(pages, none).collect()} == {None}


def test_posterior_against_brute_force(spark):
    draw = random.Random(12)
    train = spark.createDataFrame([(i, t, x) for i in range(5) for t, x in (("the house of the king and the queen", "en"), ("la maison de la reine et du roi", "fr"), ("das haus der königin und des königs", "de"))], "doc_id long, text string, lang string")
    model = langid.fit_text(train)
    bits = ["the king", "la reine", "der könig", "42", ""]  # the last two say nothing: only the other evidence tells
    rows = [(i, f"http://h{draw.randint(0, 5)}.{draw.choice(['a', 'b'])}.{draw.choice(['fr', 'de', 'com'])}/{i}" if i % 7 else draw.choice([None, "odd"]), draw.choice(["", '<html lang="fr">', "<html lang='de-AT'>"]) + draw.choice(bits)) for i in range(120)] + [(4, "http://h1.a.fr/x", "la"), (None, None, None)]
    found = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).repartition(4), model).collect()
    seen = []
    for i, url, html in rows:
        ll = np.array(model.loglik(langid.visible(html or "")))
        said = langid._LANG.search(html or "")
        seen.append((i, *langid.host_parts(url), said[1].lower() if said else "", ll, np.exp(ll) / np.exp(ll).sum()))
    total = lambda k, x: sum(r[6] for r in seen if r[k] == x)
    everything = sum(r[6] for r in seen)
    prior = (everything + 1) / (everything.sum() + 3)
    smooth = lambda n, q: (n + langid.PRIOR * q) / (n.sum() + langid.PRIOR)
    weigh = lambda k, x: np.ones(3) if x == "" else (total(k, x) + langid.TABLE) / (everything + langid.TABLE * len({r[k] for r in seen}))
    want = Counter()
    for i, host, domain, suffix, declared, ll, _ in seen:
        q = smooth(total(1, host), smooth(total(2, domain), smooth(total(3, suffix), prior)))
        score = ll + np.log(q) + np.log(weigh(4, declared)) + np.log(weigh(3, suffix))
        p = np.exp(score - score.max())
        want[(i, model.languages[int(p.argmax())], round(float(p.max() / p.sum()), 8), declared, host)] += 1
    assert Counter((r.page_id, r.language, round(r.posterior, 8), r.declared, r.host) for r in found) == want
    assert len({x[1] for x in want}) == 3


def test_every_labelled_language_is_fitted(spark):
    words = lambda k: " ".join(f"{chr(0x4E00 + 50 * k + i)}{chr(0x4E01 + 50 * k + i)}{chr(0x4E02 + 50 * k + i)}" for i in range(20))
    train = spark.createDataFrame([(100 * k + i, words(k), f"l{k:02}") for k in range(70) for i in range(2 if k else 1)], "doc_id long, text string, lang string")
    model = langid.fit_text(train)
    assert model.languages == [f"l{k:02}" for k in range(70)]
    assert all(int(np.argmax(model.loglik(words(k)))) == k for k in (0, 35, 69))


def test_url_rules(spark):
    rules = [url_filter.host_rule("allow", "org/"), url_filter.host_rule("block", "example.org/en/1"), url_filter.url_rule("block", "||bets."), url_filter.url_rule("block", "/casino/"), url_filter.url_rule("allow", "||docs."), url_filter.url_rule("block", "-loans^"), url_filter.url_rule("block", "*x*")]
    assert rules[0].tokens == ("org",) and rules[1].tokens == ("example", "org", "en") and rules[6].tokens == ()
    urls = ["http://a.Example.org/en/12", "http://example.org", "http://EXAMPLE.ORG/EN/1", "http://bets.io/q", "http://mybets.io/q", "https://q.io/Casino/1", "http://docs.io/casino/", "http://q.io/pay-loans", "http://q.io/pay-loans-now", "no scheme", None, "", "http://h?x#y", "http://org/"]
    found = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("z")), rules[:6]).collect()}
    assert [(found[i].rule, found[i].verdict) for i in range(len(urls))] == [
        ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"), (None, "block"), (None, "allow"), (None, "block"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"),
    ]
    assert (found[0].host, found[0].path) == ("a.example.org", "/en/12") and (found[12].host, found[12].path) == ("h", "") and (found[10].host, found[10].path) == ("", "")


def test_components(spark):
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 1), (7, 7)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in (e for e in edges if None not in e):
            root[a] = root[b] = min(root[a], root[b])
    found = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == root
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(fps, radius):
    root = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= radius:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("cell_rows", [3, 50_000])
def test_simhash(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash.near_links, "__kwdefaults__", {"cell_rows": cell_rows})
    base = [[f"w{random.randint(0, 50)}" for _ in range(90)] for _ in range(4)]
    texts = ["", None, "one", "one two", *[" ".join(b) for b in base]]
    for b in base:
        for _ in range(8):
            c = list(b)
            c[random.randrange(90)] = "changed"
            texts.append(" ".join(c).upper() if random.random() < 0.3 else " ".join(c))
    texts += texts[4:8]
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("fp", F.lit(1)).repartition(3)
    found = {r.doc_id: r for r in simhash.near_duplicates(df, words=4, bits=64, radius=4).collect()}
    rows = sorted((1000 - i, int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(t, 4), 64))) for i, t in enumerate(texts))
    root = brute_groups([f for _, f in rows], 4)
    assert [found[i].component_id for i, _ in rows] == [rows[k][0] for k in root]
    assert all(int.from_bytes(found[i].fp) == f for i, f in rows) and found[1000].component_id == found[999].component_id
    assert simhash.near_duplicates(df.limit(0), words=4, bits=64, radius=4).count() == 0


def test_bk_tree_and_bands(monkeypatch):
    draw = random.Random(2)
    values = [draw.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for v in values[:30]]
    values += [values[3] ^ (1 << i) for i in range(64)] + [values[5] ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(20, 30)]
    values = sorted(set(values), key=hash)
    for crowd in (2, 32, 10_000):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        links, root = simhash.cell_links(values, 4), brute_groups(values, 4)
        assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) == len(values) - len(set(root))
    for rows in (0, 10**9, 10**12):
        bands = simhash.exact_bands(64, 4, rows)
        assert rows >> min(map(len, bands)) <= 2 * simhash.CELL_MEAN
        for _ in range(100):
            flips = set(draw.sample(range(64), 4))
            assert any(not flips & set(band) for band in bands)


def test_bk_tree_finds_all_and_follows_few_edges():
    draw = random.Random(4)
    values = [draw.getrandbits(64) for _ in range(3_000)]
    values += [v ^ (1 << draw.randrange(64)) for v in values[:300]]
    tree = simhash.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for q in values[-100:]:
        assert sorted(tree.near(q, 4)) == sorted({v for v in values if (v ^ q).bit_count() <= 4})
    assert tree.visited < 0.65 * 100 * len(values)
    tree.visited = 0
    for q in values[-100:]:
        list(tree.near(q, 1))
    assert tree.visited < 0.2 * 100 * len(values)


def test_wide_simhash_finds_near_texts():
    from corpus_pipeline import BITS, RADIUS

    hits, bands = 0, simhash.likely_bands(BITS, 0.8, 100_000)
    for _ in range(60):
        a = [f"w{random.randint(0, 10**6)}" for _ in range(300)]
        b = list(a)
        for k in random.sample(range(300), 5):
            b[k] = "other"
        x, y = (np.unpackbits(np.frombuffer(simhash.fingerprint(simhash.shingle_hashes(" ".join(t), 5), BITS), np.uint8)) for t in (a, b))
        hits += (x != y).sum() <= RADIUS and any((x[band] == y[band]).all() for band in bands)
    assert hits >= 59  # likeness about 0.85


@pytest.mark.parametrize("group_rows", [5, 1000])
def test_exact_likeness_decides(spark, monkeypatch, group_rows):
    from corpus_pipeline import BITS, LIKENESS, RADIUS

    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    draw, texts = random.Random(11), []
    for _ in range(40):
        a = [f"w{draw.randint(0, 10**6)}" for _ in range(200)]
        texts.append(" ".join(a))
        for changed in (3, 5, 6, 8):  # likeness about 0.86, 0.78 to 0.81, 0.73, 0.66
            b = list(a)
            for k in draw.sample(range(200), changed):
                b[k] = "other"
            texts.append(" ".join(b))
    texts += [texts[0], "", None, texts[1]]
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), words=5, bits=BITS, radius=RADIUS, likeness=LIKENESS)
    sets, root = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a | b and len(a & b) >= LIKENESS * len(a | b)):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(root))


@pytest.mark.parametrize("rows", [1_000, 10**6, 10**8])
def test_candidate_bands_miss_few_at_the_likeness(rows):
    from corpus_pipeline import BITS, LIKENESS, RADIUS

    draw, bands = np.random.default_rng(3), simhash.likely_bands(BITS, LIKENESS, rows)
    apart = np.arccos(2 * LIKENESS / (1 + LIKENESS)) / np.pi  # of such a pair, each bit differs with this chance
    missed = 0
    for _ in range(2_000):
        flips = draw.random(BITS) < apart
        missed += flips.sum() > RADIUS or all(flips[band].any() for band in bands)
    assert missed <= 20 and rows >> len(bands[0]) <= 2 * simhash.CELL_MEAN


def test_wide_links_tell_the_components():
    values = [random.getrandbits(256) for _ in range(20)]
    values += [v ^ sum(1 << k for k in random.sample(range(256), 30)) for v in values for _ in range(4)]
    links, root = simhash.wide_links([v.to_bytes(32) for v in values], 56), brute_groups(values, 56)
    joined = list(range(len(values)))
    place = {v.to_bytes(32): k for k, v in enumerate(values)}
    for a, b in links:
        x, y = joined[place[a]], joined[place[b]]
        joined = [min(x, y) if r in (x, y) else r for r in joined]
    assert joined == root and len(links) == len(values) - len(set(root))


@pytest.mark.parametrize("held", [50, 100_000])
def test_forest_joins_the_same_with_a_link_for_each_member(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "FOREST_LINKS", held)
    draw = random.Random(8)
    group, other = [[draw.randbytes(32) for _ in range(n)] for n in (60, 25)]
    pairs = [(x, draw.choice(some)) for some in (group, other) for x in some for _ in range(20)]  # as if the groups met in 20 bands
    pairs += list(zip(group, group[1:])) + list(zip(other, other[1:]))
    found = simhash.forest(spark.createDataFrame(pairs, "a binary, b binary").repartition(5)).collect()
    joined = {r.node: r.root for r in common.connected_components(spark.createDataFrame([(bytes(r.a), bytes(r.b)) for r in found], "a binary, b binary")).collect()}
    assert {bytes(k): bytes(v) for k, v in joined.items()} == {x: min(some) for some in (group, other) for x in some}
    assert len(found) == 83 if held > 50 else len(found) < len(pairs)
    assert not simhash.forest(spark.createDataFrame([], "a binary, b binary")).collect()


def test_near_duplicates_gather_no_link_for_each_band(spark, monkeypatch):
    from corpus_pipeline import BITS, LIKENESS, RADIUS

    seen, components = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: (seen.append(links.count()), components(links))[1])
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(120)]
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5, bits=BITS, radius=RADIUS, likeness=LIKENESS)
    assert {r.component_id for r in found.collect()} == {0}
    assert seen and max(seen) < len(texts)


@pytest.mark.parametrize("bound", [500, 900, 10])
def test_toxic_examples_are_bounded_in_terms(spark, monkeypatch, bound):
    monkeypatch.setattr(toxicity, "POSTINGS", bound, raising=False)
    texts = [" ".join([("vile" if i % 3 == 0 else "kind"), *[f"{i}w{k}" for k in range(4 if i % 3 == 0 else 30)]]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    drawn, sizes = set(index.ids.tolist()), [len(toxicity.terms(t)) for t in texts]
    assert len(index.example) == sum(sizes[i] for i in drawn) <= max(bound, sizes[0] + sizes[1]) and index.toxic.sum() >= 1 and (index.toxic == 0).any()
    hashed = {r.id: r.h for r in spark.range(60).select("id", F.xxhash64("id").alias("h")).collect()}
    for toxic in (True, False):  # the first ones in the hash's order, with no gap
        own = sorted((i for i in range(60) if (i % 3 == 0) == toxic), key=hashed.get)
        assert set(own[: len(drawn & set(own))]) == drawn & set(own)
    assert bound == 10 or index.score("vile")[0] > index.score("kind")[0]  # one example of each has no neighbour to calibrate by


def test_quality(spark, docs):
    def brute(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [s for s in (t or "").split("\n") if s.translate({c: None for c in (9, 10, 11, 12, 13, 32)})]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        places = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places)

    extra = ["a b c a b c a b c", "x\nx\n \nx y", "# * $ % & | < >", "the of and " * 40, "word " * 60, " ".join(f"the word{i}" for i in range(60)), " ".join(f"qq{i}" for i in range(60))]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *extra])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("quality", F.lit(2))
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    n = len(TEXTS)
    assert not found[n + 3].kept and found[n + 5].kept and not found[n + 6].kept
    assert quality.keep(df).columns == df.columns and quality.keep(df.limit(0)).count() == 0
    plan = quality.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def dense_vectors(texts, fitted, labels, totals):
    """Unit TF-IDF vectors over all terms of all texts, by dictionaries; idf from the fitted ones."""
    held, whole = Counter(), sum(totals)
    drawn = Counter(labels)
    for t, y in zip(fitted, labels, strict=True):
        for term in toxicity.terms(t):
            held[term] += totals[y] / drawn[y]
    out = []
    for t in texts:
        v = {term: n * min(math.log((1 + whole) / (1 + held[term])), toxicity.RAREST) for term, n in toxicity.terms(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({k: x / norm for k, x in v.items()})
    return out


def test_block_max_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "LONG_LIST", 20)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    draw = random.Random(9)
    kinds = [[f"{c}{draw.randint(100, 99999)}{draw.choice('aeiou')}" for _ in range(300)] for c in "xyz"]
    texts = ["", "!!", *[" ".join(draw.choices(kinds[i % 3], k=draw.randint(1, 40))) for i in range(400)]]
    labels, totals = [int(draw.random() < 0.4) for _ in texts], (9000, 1000)
    counts = [toxicity.terms(t) for t in texts]
    index = toxicity.build(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "toxic": pa.array(labels, pa.int32()), "terms": pa.array([list(c) for c in counts], pa.list_(pa.string())), "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))}), totals)
    asked = [" ".join(draw.choices(kinds[i % 3] + ["unseen", "other"], k=30)) for i in range(60)] + ["unseen words alone qqq", ""]
    vectors, own = dense_vectors(texts, texts, labels, totals), dense_vectors(asked, texts, labels, totals)
    for t, q in zip(asked, own, strict=True):
        cosines = {k: sum(w * v.get(term, 0.0) for term, w in q.items()) for k, v in enumerate(vectors)}
        got = index.nearest(index.vector(t), 10)
        assert np.allclose([s for s, _ in got], sorted((c for c in cosines.values() if c > 1e-6), reverse=True)[:10], atol=2e-6)
        assert all(abs(cosines[int(index.ids[j])] - s) < 2e-6 for s, j in got)
    index.visited = index.asked = 0
    for i in index.ids[::9]:
        index.nearest(index.vector(texts[i]), 1)
    assert 0 < index.long < len(index.names) and index.visited < 0.7 * index.asked * index.blocks


def toxic_index_of(texts, labels):
    counts = [toxicity.terms(t) for t in texts]
    return toxicity.build(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "toxic": pa.array(labels, pa.int32()), "terms": pa.array([list(c) for c in counts], pa.list_(pa.string())), "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))}), (900, 100))


def test_words_of_examples_are_taken_apart_once(monkeypatch):
    index = toxic_index_of([f"example{i} wordy{i} été" for i in range(40)], [i % 2 for i in range(40)])
    texts = [f"example{i % 40} wordy{i % 40} été " + " ".join(f"rare{i}x{k}" for k in range(30)) for i in range(120)]
    want, taken, whole = [index.score(t) for t in texts], Counter(), toxicity.terms_of
    index.ready = False
    monkeypatch.setattr(toxicity, "FORMS", 50)
    monkeypatch.setattr(toxicity, "terms_of", lambda word: taken.update([word]) or whole(word))
    index.prepare()
    assert [index.score(t) for t in texts] == want
    assert max(taken[w] for i in range(40) for w in (f"example{i}", f"wordy{i}", "été")) <= 1
    assert len(index.forms) <= len(index.names) + 50 + 30  # those of one text beside


def test_blocks_are_read_once_for_all_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "LONG_LIST", 20)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    draw = random.Random(4)
    texts = [" ".join(draw.choices(VOCAB + [f"w{i}" for i in range(300)], k=draw.randint(1, 60))) for _ in range(300)]
    index = toxic_index_of(texts, [int(draw.random() < 0.4) for _ in texts])
    asked = ["", "nothing known", *texts[::3], *texts[:20], LONG]

    class Lists:
        whole, read = index.lists, 0

        def __getitem__(self, at):
            Lists.read += int(np.ndim(at[0]) == 0) + np.size(self.whole[at]) / self.whole[0].size * int(np.ndim(at[0]) > 0)
            return self.whole[at]

    alone = [index.score(t) for t in asked]
    index.lists, index.visited = Lists(), 0
    scores, evidence = index.scores(asked)
    assert index.blocks < Lists.read < 0.2 * index.visited  # 0.2: the few sums in 64 bits are read too
    assert alone == [(s, [tuple(x.values()) for x in e]) for s, e in zip(scores.tolist(), evidence.to_pylist(), strict=True)] and alone[0][1] == alone[1][1] == []
    back = index.scores(asked[::-1])[1].to_pylist()[::-1]
    assert back == evidence.to_pylist() and index.scores([])[1].to_pylist() == []
    held, whole = [], index.nearest_of
    index.nearest_of = lambda queries, k: held.append([len(found) for found, _ in queries]) or whole(queries, k)
    monkeypatch.setattr(toxicity, "TERMS_TOGETHER", 100)  # long texts wait for no others
    assert index.scores(asked)[1].to_pylist() == evidence.to_pylist() and all(sum(x[:-1]) < 100 for x in held) and sum(map(len, held)) == len(asked)


def test_words_are_those_the_pattern_finds():
    every = "".join(f"A{chr(c)}b{chr(c)}{chr(c)}1" for c in range(0x2100) if not 0xD800 <= c < 0xE000)
    for t in [*TEXTS, every, every[: 7 * 256], "İstanbul straße ÀÉ\x85x\xa0y_z\x1cq ²µªº", "“quoted” words—here"]:
        assert toxicity.words(t or "") == __import__("re").findall(r"[^\W_]+", (t or "").lower())


def test_toxicity(spark):
    draw = random.Random(3)
    words = [f"plain{i}" for i in range(200)]
    rows = [(i, " ".join(draw.choices(words, k=30) + (["vilething"] * 2 if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, "", 0), (902, "plain1 " * 30_000 + "vilething", 0), (905, "unheard of", 0), (None, "plain1", 0), (3, rows[3][1], 0)], "doc_id long, text string, toxic int").withColumn("score", F.lit("s"))
    labels = df.where("doc_id < 200 OR doc_id IN (900, 901)").select("doc_id", "toxic").union(spark.createDataFrame([(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    index = toxicity.fit(df.select("doc_id", "text"), labels)
    found = {r.doc_id: r for r in toxicity.score(df, index, into=("s", "e"), extra=["score"]).collect()}
    assert sum((found[i].s >= 0.3) == bool(y) for i, _, y in rows) >= 295 and found[900].s < 0.3 and found[901].e == []
    assert all(len(found[i].e) == toxicity.NEIGHBOURS for i, _, _ in rows) and found[905].e == [] and len(found[902].e) == toxicity.NEIGHBOURS
    assert toxicity.score(df, index).where("doc_id = 3").select("score").distinct().count() == 1 and toxicity.score(df.limit(0), index).count() == 0
    empty = toxicity.fit(df.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in toxicity.score(df, empty).collect()} == {0.0}


def test_a_worker_frees_the_caches_of_the_operator_before(spark, monkeypatch):
    monkeypatch.setitem(spark.sparkContext.environment, "OWN_WORKER", "caches")  # a pool of its own: one worker takes all tasks of one partition
    df = spark.createDataFrame([(i, f"plain{i % 7} words here", i % 2) for i in range(40)], "doc_id long, text string, toxic int").coalesce(1)

    def alive(source):
        import gc
        import os

        for _ in source:
            pass
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [sum(isinstance(x, tokens.Cache) for x in gc.get_objects())]})

    look = lambda: tuple(df.mapInArrow(alive, "pid long, n long").collect()[0])
    pid, n = look()
    assert n == 0
    counts = tokens.token_counts(df, PIECE).collect()
    assert look() == (pid, 2)
    pieces = tokens.token_pieces(df, WORD, max_len=64).collect()
    assert look() == (pid, 1)
    index = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(toxicity.score(df, index).collect()) == 40 and look() == (pid, 0)
    assert tokens.token_counts(df, PIECE).collect() == counts and tokens.token_pieces(df, WORD, max_len=64).collect() == pieces and look() == (pid, 1)


def tree_budgets(available, weights, total, epochs):
    """Tokens of leaves by recursion: what the level-by-level plan must give."""
    given = {}

    def deal(at, leaves, tokens):
        if leaves == [at]:
            given[at] = tokens
            return
        below = defaultdict(list)
        for leaf in leaves:
            below[leaf[: len(at) + 1]].append(leaf)
        hold = {k: epochs * sum(available[x] for x in v) for k, v in below.items()}
        for k, n in mixing.share(tokens, hold, {k: float(weights.get(k, 1.0)) for k in below}).items():
            deal(k, below[k], n)

    if available:
        deal((), sorted(available), total)
    return given


def test_share_and_budgets(spark):
    assert mixing.share(10, {"a": 2, "b": 50, "c": 50}, {"a": 1, "b": 1, "c": 3}) == {"a": 2, "b": 2, "c": 6}
    assert mixing.share(100, {"a": 3, "b": 4}, {"a": 1, "b": 1}) == {"a": 3, "b": 4} and mixing.share(5, {}, {}) == {}
    have = {("p", "x"): 10, ("p", "y"): 100, ("q", "z"): 100}
    assert tree_budgets(have, {("q",): 1.0}, 100, 1) == {("p", "x"): 10, ("p", "y"): 40, ("q", "z"): 50}  # x's shortage goes to y, its sibling
    assert tree_budgets({("p", "x"): 10, ("q", "z"): 100}, {}, 100, 2) == {("p", "x"): 20, ("q", "z"): 80}  # a whole branch's shortage goes to the next
    draw = random.Random(8)
    have = {(a, b, c): draw.randint(0, 40) for a in "pqr" for b in "uv" for c in ["", 's"1', "é"] if draw.random() < 0.8}
    weights = {("p",): 3.0, ("q", "u"): 0.5, ("r", "v", "é"): 4.0, ("q", "v"): 0.0}
    totals = spark.createDataFrame([(list(k), n) for k, n in have.items()], "mix_leaf array<string>, n long")
    for total in (0, 150, 500, 10_000):
        assert {tuple(r.mix_leaf): r.tokens for r in mixing.budgets(totals, 3, weights, total, 2).collect()} == tree_budgets(have, weights, total, 2)


@pytest.mark.parametrize("range_rows", [1, 256])
def test_mix_against_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    draw = random.Random(6)
    rows = [(i, draw.choice("ab"), draw.choice(["u", None]), draw.choice([0, 3, 7, None])) for i in range(400)] + [(5, "a", "u", 3)] * 4 + [(None, "a", "u", 7)] * 3 + [(900, None, "w", 0)]
    df = spark.createDataFrame(rows, "doc_id long, d string, s string, n long").withColumn("range", F.lit("r")).withColumn("mix_epoch", F.lit(9)).repartition(3)
    found = mixing.mix(df, levels=[F.col("d"), F.col("s")], tokens=F.col("n"), key=F.col("doc_id"), total=900, weights={("a",): 3.0}, epochs=2, seed=1)
    got = Counter((r.doc_id, r.d, r.s, r.mix_epoch) for r in found.collect())
    leaves = defaultdict(list)
    for row in rows:
        leaves[(row[1] or "", row[2] or "")].append(row)
    have, want = {k: sum(r[3] or 0 for r in v) for k, v in leaves.items()}, Counter()
    for leaf, given in tree_budgets(have, {("a",): 3.0}, 900, 2).items():
        full, rest = divmod(given, have[leaf]) if have[leaf] else (0, 0)
        for e in range(full):
            want.update((r[0], r[1], r[2], e) for r in leaves[leaf])
        keys, upto = defaultdict(list), 0
        for r in leaves[leaf] if rest else []:
            keys[hashlib.md5(f"1:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest()].append(r)
        for _, same in sorted(keys.items()):
            upto += sum(r[3] or 0 for r in same)
            if upto > rest:
                break
            want.update((r[0], r[1], r[2], full) for r in same)
    assert got == want and len(want) > 100
    assert mixing.mix(df.limit(0), levels=[F.col("d")], tokens=F.col("n"), key=F.col("doc_id"), total=0.5).count() == 0


def test_mix_counts_tokens(spark, tmp_path):
    import sentencepiece

    from trovel.llm import queries

    texts = [None, "", " ", "one two", "nine " * 50, *[f"text {i} of a source" for i in range(40)]]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = queries.op9_source_mix(spark, str(tmp_path)).collect()
    assert found and all(r.mix_tokens == len(lib.encode(texts[r.doc_id] or "")) for r in found)
    assert 0.7 < sum(r.mix_tokens for r in found) / sum(len(lib.encode(t or "")) for t in texts) <= 0.8


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    good = lambda k: " ".join(f"the word{k}x{i} of" for i in range(40))
    rows = [(i, good(i), "en", "src1", 1) for i in range(20)] + [(100, good(3), "en", "src2", 1), (101, good(4) + " end", "en", "src3", 1), (102, "short", "en", "src1", 1), (103, None, None, None, None), (104, "# $ % the of " * 30, "en", "src1", 1), (None, good(7), "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs.withColumn("score", F.lit(1)) if k < 3 else docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = sorted(r.doc_id for r in docs.select("doc_id").distinct().collect() if r.doc_id is not None)
        if k in (0, 1):
            assert ids == [*range(20), 100, 101]
        elif k == 2:
            assert ids == list(range(20))
        docs = docs.drop("score") if k < 3 else docs
        assert k == 4 or docs.columns == before.columns
    own = {r.doc_id: r for r in docs.collect()}
    assert own and all(r.start == 0 and r.length <= 2048 for r in own.values())
    P.STAGES[2][1](spark, before.limit(0), str(tmp_path)).collect()


def test_entry_lists_all():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)


def test_crc_of_ids():
    assert zlib.crc32(array("I", [1, 2]).tobytes()) == zlib.crc32(np.array([1, 2], "<u4").tobytes())
