"""Every operator against brute force, and the odd cases that its docstring defines."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodex.llm import bitpack, decontaminate, html, language, neighbours, packing, pii, sharding, simhash, toxicity
from lodex.llm.tokens import Encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, score string, slot string"
LONG = "Thonble reatti, of the and 12.5 is. " * 4000


def table(spark, texts, ids=None):
    """Documents with extra columns that clash with names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


ODD = [None, "", " \n\t ", "a", "Hello, world! it's <|endoftext|> é ﬁ", LONG, "same text here", "same text here", "日本語 テキスト", "12 34", "\x00 nul"]
ODD_IDS = [0, 1, 2, 3, 4, 5, 6, 6, 8, None, 10]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD, ODD_IDS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def library(text, end):
    ids = Encoder.of(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], dtype="<u4")


# --- tokens, op9, op3


def test_encoder_equals_the_library_on_hard_texts():
    rng, e = random.Random(3), Encoder(vocabulary_path())
    assert e.by_word
    alphabet = "abcXYZ éÉßİıΣςÀ́  \t\n\r\x0b\x0c\x1c\x85\xa0.,!?'’“”…-_<|>0129$#日本ﬁ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>", "x<|startoftext|>y's 'S can't", None]
    flat, at = e.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == library(t, 0)[:-1].tolist(), repr(t)


@pytest.mark.parametrize("bits", [1, 2, 7, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5000, dtype=np.uint64).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)) == ids).all()
    assert bitpack.pack(ids[:3200], bits).nbytes == 3200 * bits // 8


@pytest.mark.parametrize("block", [32, 100, 4096])
def test_image_gives_random_access(tmp_path, block):
    docs = [np.random.default_rng(i).integers(0, 49408, n).astype(np.uint32) for i, n in enumerate([5, 0, 1000, 1, 4096, 33])]
    bitpack.save(bitpack.image([3, None, 5, 6, 7, 9], docs, 16, 11, block), str(tmp_path / "a.bits"))
    own = bitpack.open_image(str(tmp_path / "a.bits"))
    flat = np.concatenate(docs)
    assert own.first == 11 and own.bits == 16 and (own.ids() == flat).all()
    for k, d in enumerate(docs):
        assert (own.document(k) == d).all()
    for a, b in [(0, 1), (31, 33), (4, 5000), (5100, 5135), (7, 7)]:
        assert (own.ids(a, b) == flat[a:b]).all()


def test_images_keep_every_doc_id(tmp_path):
    own = bitpack.Image(bitpack.image([-(2**63), None, 0, 2**63 - 1], [np.array([k], np.uint32) for k in range(4)], 16))
    assert own.doc_ids.tolist() == [-(2**63), 0, 0, 2**63 - 1] and own.no_id.tolist() == [False, True, False, False]
    assert bitpack.Image(bitpack.image([], [], 16)).ids().tolist() == []


def test_one_doc_id_is_divided_and_in_fixed_order(spark):
    """A doc_id with most rows, of different and of equal texts, goes to many partitions."""
    from lodex.llm.common import in_order

    texts = ["same text", *(f"text number {k} " * 400 for k in range(2000))] + ["same text"] * 2000
    docs = table(spark, texts, [7] * 4000 + [-(2**63)])
    spread = [r.n for r in in_order(docs).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(spread) > 1 and max(spread) < 3 * 4001 / len(spread)
    ways = [[(r.doc_id, r.start, r.ids_crc32) for r in sorted(bitpack.round_trip(d).collect(), key=lambda r: r.start)] for d in (docs, docs.repartition(5))]
    assert ways[0] == ways[1] and ways[0][0][0] == -(2**63)


def test_pack_refuses_large_ids():
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8], np.uint32), 3)


def test_round_trip_of_odd_documents(spark, odd, none):
    got = sorted(bitpack.round_trip(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 5, 6, 6, 8, 10]
    at = 0
    for r in got:
        ids = library(ODD[ODD_IDS.index(r.doc_id)], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bitpack.round_trip(none).count() == 0


def pieces_are_whole(rows, documents, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    for doc, own in by_doc.items():
        copies = [library(t, 1) for i, t in documents if i == doc]
        assert sum(r.length for r in own) == sum(map(len, copies))
        for r in own:
            assert r.ids_crc32 in [zlib.crc32(c[r.start : r.start + r.length].tobytes()) for c in copies]
    return by_seq


def test_packing_keeps_every_id_once(spark, odd, none):
    rows = packing.pack(odd, chunk=3000).collect()
    pieces_are_whole(rows, list(zip(ODD_IDS, ODD)), 2048)
    assert packing.pack(none).count() == 0


def test_packing_is_optimal_on_small_lines():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pos = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 9, 12)))))
        penalty = rng.integers(0, 6, len(pos))
        dp, prev = packing.solve(pos, penalty, window=16, least_power=4, each=2)
        best = [0] + [10**9] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                size = pos[j] - pos[i]
                if size <= 16:
                    pad = 0 if size in (4, 8) else 16 - size
                    best[j] = min(best[j], best[i] + pad + penalty[j] + 2)
        assert dp == [int(x) for x in best]


def test_packing_wastes_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).collect()
    seqs = pieces_are_whole(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    lengths = [sum(r.length for r in own) for own in seqs.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.02 * sum(lengths)


# --- op8


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, distance):
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for d, f in items:
        if d is not None:
            low[find(f)] = min(low.get(find(f), d), d)
    return [low.get(find(f)) for _, f in items]


def test_fingerprints_by_definition():
    rng = random.Random(1)
    for t in [*ODD, *("".join(rng.choice(" \nabÉ\x0b\xa0Z") for _ in range(rng.randint(0, 200))) for _ in range(300))]:
        assert simhash.fingerprint(t) == slow_fingerprint(t), repr(t)


@pytest.mark.parametrize(("block", "segments"), [(1024, None), (16, None), (64, 7)])
def test_components_equal_brute_force(spark, block, segments):
    """Fingerprints around a few centres, so that chains of links and hot buckets occur."""
    rng = np.random.default_rng(block)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = []
    for _ in range(400):
        f = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(b)
        fps.append(f)
    items = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 4, segments, block)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    low = {}
    for i, s in enumerate(signed):
        low[roots.get(s, s)] = min(low.get(roots.get(s, s), i), i)
    assert [low[roots.get(s, s)] for s in signed] == slow_components(items, 4)


def test_near_duplicates_of_odd_documents(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    want = slow_components([(i, slow_fingerprint(t)) for i, t in zip(ODD_IDS, ODD)], 4)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in rows) == sorted(((i is None, i or 0), f"{slow_fingerprint(t):016x}", c) for i, t, c in zip(ODD_IDS, ODD, want))
    assert simhash.near_duplicates(none).count() == 0


# --- op1


def toxic_texts(n, seed):
    rng = random.Random(seed)
    words = ["ta", "ren", "mola", "liska", "dor", "vento", "shu", "pinta", "gra", "eloth", "anter", "mirol"]
    insults, groups = ["zonk", "blart"], ["northers", "southers"]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        kind = i % 4
        if kind == 0:
            text += [rng.choice(insults), rng.choice(groups)]
        elif kind == 1:
            text += [rng.choice(insults)]
        elif kind == 2:
            text += [rng.choice(groups)]
        rng.shuffle(text)
        out.append((" ".join(text), int(kind == 0)))
    return out


def test_machine_learns_pairs_that_weights_cannot():
    """Toxic only where an insult meets a group."""
    train, test = toxic_texts(3000, 1), toxic_texts(400, 2)
    m = toxicity.fit([toxicity.columns(t) for t, _ in train], np.array([y for _, y in train]), keep=1.0, epochs=60)
    right = [(s >= 0.5) == bool(y) for s, (_, y) in zip(m.scores([t for t, _ in test]), test)]
    assert np.mean(right) > 0.97
    linear = toxicity.Machine(m.bits, m.weighed, m.bias, m.w, np.zeros_like(m.v))
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(linear.scores([t for t, _ in test]), test)]) < np.mean(right)


def test_pairs_are_learned_without_weights_of_their_own():
    """The label depends on two words together and on neither alone."""

    def texts(n, seed):
        rng, out = random.Random(seed), []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            words = [rng.choice("ta ren mola liska dor vento shu pinta gra eloth".split()) for _ in range(20)] + ["northers" if a else "westers", "zonk" if b else "blart"]
            rng.shuffle(words)
            out.append((" ".join(words), int(a == b)))
        return out

    train, test = texts(4000, 1), texts(400, 2)
    m = toxicity.fit([toxicity.columns(t) for t, _ in train], np.array([y for _, y in train]))
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(m.scores([t for t, _ in test]), test)]) > 0.97


def test_one_doc_id_with_many_texts_stays_bounded(spark):
    docs = table(spark, [f"text {k}" for k in range(3000)] + ["text 0"] * 3000 + ["other words"], [6] * 6000 + [7])
    labels = spark.createDataFrame([(6, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows, y = toxicity.sample(docs, labels, 500, F.lit(True))
    assert 300 < len(rows) < 700 and len(y) == len(rows)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(20, np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    at = np.array([1, 4, 7, 8])
    want = 0.3 + m.w[at].sum() + sum(m.v[a] @ m.v[b] for k, a in enumerate(at) for b in at[:k])
    assert abs(m.margin(at) - want) < 1e-9


def test_toxicity_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 1), (5, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    empty = toxicity.score(none, toxicity.train(none, labels))
    assert empty.count() == 0
    kept = toxicity.without_toxic(odd, toxicity.Machine(20, np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, 4))))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_toxicity_holds_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit = out[(out.predicted == 1) & (out.toxic == 1)]
    assert len(hit) / (out.toxic == 1).sum() > 0.8 and len(hit) / out.predicted.sum() > 0.97


# --- op2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<div class="cookie-banner"><p>We use cookies. Accept all of them now.</p></div><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<!-- <p>hidden</p> --><article><h1>The &amp; head</h1><p>First   para
graph &#233; with <b>bold</b> text and more words to read.<p>Second, unclosed; it has several words, too.<div class="ad">Buy now, cheap things for you today.</div>
<p>Third with<br>break and a final word in it.</p></article>
<section class="comments"><h3>Comments</h3><div class=comment><p>I disagree with all of this, my friend.</p></div></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; x.example &middot; All rights reserved here.</footer></body></html>"""


def test_main_text_of_a_page():
    want = "The & head\nFirst para graph é with bold text and more words to read.\nSecond, unclosed; it has several words, too.\nThird with break and a final word in it."
    assert html.main_text(PAGE, html.default_field()) == want


def test_attributes_behind_long_ones_count():
    long = f'<div data-state="{"x" * 5000}" class="sidebar advert" id="menu">text</div>'
    assert html.blocks(long)[0].path == {"t:div", "n:sidebar", "n:advert", "n:menu"}
    assert html.blocks(f'<p>seen</p><div data-state="{"x" * 5000}" hidden>unseen</div>') == html.blocks("<p>seen</p>")
    many = "".join(f"<p class='c{k}'>x</p>" for k in range(9000))
    assert len(html.blocks(many)) == 9000 and html.features_of.cache_info().currsize <= 4096


ARTICLE = "<html><body><article><h1>A fine day</h1>{}</article></body></html>"


@pytest.mark.parametrize(("inside", "want"), [
    ("<p>One two three four <a title=it's href=x>link</a> five.</p><p>Second para graph with it's words in.</p>", "One two three four link five.\nSecond para graph with it's words in."),
    ('<p>One two three four <a title="foo>link</a> five six.</p><p class="x">Second para graph with words in.</p>', "One two three four link five six.\nSecond para graph with words in."),
    ('<p>One two three four <a title="foo>link</a> five six.</p><p>Second para graph with words in.</p>', "One two three four link five six.\nSecond para graph with words in."),
    ('<p>One two three four five six.</p><p><a data-x="<b>no</b>" href=y>Second</a> para graph with words in.</p>', "One two three four five six.\nSecond para graph with words in."),
    ("<p>One two three four five six.</p><button>Subscribe now</button><select><option>One<option>Two</select><p>Second para <label>Mail</label> graph with words in.</p>", "One two three four five six.\nSecond para graph with words in."),
    ("<p>One two three <button>Buy<p>Second para graph with words in.</p>", "One two three\nSecond para graph with words in."),
    ('<p>One two three four five six.</p><div hidden><p>No one is to see these words here.</p></div><p style="display: none">None of this is seen, ever.</p><p aria-hidden="true">Nor that one, a long one indeed.</p>', "One two three four five six."),
    ("<p>One two three four five < six.</p><p>Second <3 para graph with words in.</p>", "One two three four five < six.\nSecond <3 para graph with words in."),
])
def test_broken_and_hidden_markup(inside, want):
    assert html.main_text(ARTICLE.format(inside), html.default_field()) == "A fine day\n" + want


def test_unnamed_parts_are_known_by_their_words():
    page = "<html><body><div><h1>A fine day</h1><p>One two three four five six seven, eight.</p><p>Nine ten eleven twelve, and so on.</p></div><div><h3>Comments</h3><div><p>I do not agree with this, my friend, at all.</p></div></div><div>Impressum Datenschutz</div></body></html>"
    assert html.main_text(page, html.default_field()) == "A fine day\nOne two three four five six seven, eight.\nNine ten eleven twelve, and so on."


@pytest.mark.parametrize("hostile", ["<div>x" * 20_000, "".join(f"<div class=c{k}k{chr(97 + k % 26)}>x" for k in range(20_000)), '<a b="' * 20_000, "<a b='x" * 20_000, "<b>" * 20_000 + "<i>" * 20_000 + "</b>" * 20_000, "<ul><li><ul>" + "<h1>" * 10_000 + "<li></li>" * 10_000, "<b><p>" + "<i>" * 20_000 + "</b>" * 20_000, "<a " + "b " * 100_000 + ">", "<!-- " * 50_000, "<script>" * 20_000, "<" * 100_000])
def test_hostile_pages_take_linear_time(hostile):
    begun = time.perf_counter()
    html.main_text(hostile, html.default_field())
    assert time.perf_counter() - begun < 4


def test_shipped_weights_are_the_learned_ones():
    learned, shipped = html.fit(html.labelled_pages()), html.default_field()
    assert set(learned.weights) == set(shipped.weights)
    assert all(np.allclose(learned.weights[k], shipped.weights[k], atol=1e-3) for k in learned.weights) and np.allclose(learned.moves, shipped.moves, atol=1e-3)


def test_extraction_holds_out():
    field, wrong, n = html.default_field(), 0, 0
    for page in html.labelled_pages(120, seed=1234):
        labels = field.decode([b for b, _ in page])
        wrong += sum(a != b for a, (_, b) in zip(labels, page))
        n += len(page)
    assert wrong < 0.01 * n


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    field = html.default_field()
    for page in html.labelled_pages(20, seed=8):
        found = [b for b, _ in page][:9]
        scores = field.scores(found)
        if not found:
            continue

        def total(labels):
            return sum(s[y] for s, y in zip(scores, labels)) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))

        best = max(total([code >> k & 1 for k in range(len(found))]) for code in range(1 << len(found)))
        assert abs(total(field.decode(found)) - best) < 1e-9
    assert rng is not None


def test_extraction_of_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain words only, without any tag at all."), (4, "u", "<p>" * 5000), (5, "u", "<div><<>> &bogus; </b></p>" + "<script>x"), (5, "u", PAGE), (None, "u", PAGE), (7, "u", "<article><p>" + "word " * 200_000)]
    rows = html.extract(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert rows[0].text == rows[1].text == rows[3].text == "" and rows[5].text == rows[6].text and len(rows[7].text) == 999_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- op4


def slow_local(item, region):
    h = np.zeros((len(item) + 1, len(region) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(region, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 30))
        assert decontaminate.align(a, b)[0] == slow_local(a, b)


@pytest.fixture(scope="module")
def bench_items(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    return words, items, spark.createDataFrame([*enumerate(items), (20, items[0]), (21, None), (22, "too short")], "item_id long, text string")


def test_leaks_exact_edited_and_frequent(spark, bench_items):
    words, items, bench = bench_items
    rng = random.Random(9)

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    edited = items[1].split()
    for k in (3, 11, 17, 24):
        edited[k] = "changed"
    del edited[14]
    part = " ".join(items[2].split()[:8])
    texts = [prose(200), prose(50) + " " + items[0].upper().replace(" ", ", ") + "! " + prose(900), prose(60) + " " + " ".join(edited) + " " + prose(60), prose(50) + " " + part + " " + prose(50), None, "", *[prose(5) + " " + items[3] for _ in range(300)]]
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    want = {(1, 0), (1, 20), (2, 1)} | {(k, 3) for k in range(6, 306)}
    assert got == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]


@pytest.mark.parametrize("length, edits, copies", [(20, (4, 9, 14), 2), (40, tuple(range(5, 40, 5)), 2), (59, tuple(range(5, 55, 5)), 50)])
def test_repeated_edited_copies_are_leaks_beside_a_whole_one(spark, length, edits, copies):
    item = [f"word{k}" for k in range(length)]
    edited = ["changed" if k in edits else w for k, w in enumerate(item)]
    docs = table(spark, [" ".join(item), *[f"before it {' '.join(edited)} after it"] * copies, "word0 word1 word2 and no more"])
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contamination(docs, bench).collect()}
    assert set(got) == set(range(copies + 1)) and got[0] == 1.0
    assert all(got[k] == pytest.approx((2 * length - 3 * len(edits)) / (2 * length)) for k in range(1, copies + 1))
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [copies + 1]


def test_leaks_do_not_depend_on_blocks(spark, bench_items):
    words, items, bench = bench_items
    docs = table(spark, [f"x y z {items[4]} end", items[9], "a b c"], [5, None, 7])
    whole = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    assert sorted(map(str, decontaminate.contamination(docs, bench, block_words=100).collect())) == whole and len(whole) == 2
    assert [r.doc_id for r in decontaminate.clean(docs, bench, block_words=100).collect()] == [7]


def test_seeds_lose_little_against_full_alignment(spark):
    """Copies with up to two fifths of their words replaced, dropped or doubled: every text is aligned
    with every item, whole."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    items = [[rng.choice(words) for _ in range(rng.randint(6, 50))] for _ in range(40)]
    docs = []
    for k in range(240):
        copy = []
        for w in items[k % 40]:
            r, edits = rng.random(), (k % 9) / 20
            copy += [w] if r > edits else [rng.choice(words)] if r > edits / 2 else [] if r > edits / 4 else [w, w]
        docs.append([rng.choice(words) for _ in range(30)] + copy + [rng.choice(words) for _ in range(30)])
    number = {w: i + 1 for i, w in enumerate(words)}
    coded = [np.array([number[w] for w in t]) for t in items], [np.array([number[w] for w in t]) for t in docs]
    want = {(d, i): s for d, text in enumerate(coded[1]) for i, item in enumerate(coded[0]) if (s := decontaminate.align(item, text)[0] / (2 * len(item))) >= 0.5}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contamination(table(spark, [" ".join(t) for t in docs]), bench).collect()}
    assert set(got) <= set(want) and all(got[k] <= want[k] for k in got) and len(got) >= 0.98 * len(want) and len(want) > 150


def test_short_items_and_scripts_without_spaces(spark):
    bench = spark.createDataFrame([(1, "What is the capital city?"), (2, "Paris"), (3, "日本の首都はどこですか教えてください"), (4, "two words"), (None, "Paris!"), (6, ""), (7, None), (2, "Paris")], "item_id long, text string")
    docs = table(spark, ["so what is the Capital, city of it", "what is the big capital city", "paris", "I saw Paris today", "彼は日本の首都はどこですか教えてくださいと言った", "Two, words!", "two words more", None, ""])
    got = sorted(((r.doc_id, r.item_id or 0, r.score) for r in decontaminate.contamination(docs, bench).collect()))
    assert got == [(0, 1, 1.0), (2, 0, 1.0), (2, 2, 1.0), (4, 3, 1.0), (5, 4, 1.0)]


def test_grams_of_many_items_are_no_seeds(spark):
    """A common opening opens no window by itself; items that have nothing else still have seeds."""
    opening = "which of the following statements is true about"
    items = [f"{opening} a{k} b{k} c{k} d{k} e{k} f{k} g{k}" for k in range(100)]
    own = decontaminate.index([([k], t) for k, t in enumerate(items)])
    assert len(own.grams) == 100 * 7
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = decontaminate.contamination(table(spark, [items[5], opening, "x " + items[7].replace("b7", "z")]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.score > 0.8) == [(0, 5), (2, 7)]
    same = decontaminate.index([([k], f"{opening} {'more ' * k}") for k in range(60)])
    assert set(same.of_item.tolist()) == set(range(60))


def test_leaks_of_empty_tables(spark, odd, none, bench_items):
    bench = bench_items[2]
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.contamination(odd, bench).count() == 0


# --- op5


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randint(0, 400) for _ in range(3000)] + ["hot copy " * 20] * 1500 + [None, ""]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.col("source")))
    rows = sharding.shard(docs).toPandas()
    assert len(rows) == len(texts) and set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    weight = rows.groupby("shard")["size"].sum()
    assert sorted(weight.index) == list(range(24)) and weight.max() < 1.02 * weight.mean() and weight.min() > 0.98 * weight.mean()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    by = {i: t for i, t in enumerate(texts)}
    for r in rows.itertuples():
        raw = (by[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)


def slow_tree(rows, shards):
    """The same tree from sorted lists: (row, key along each dimension, size, text) -> first shard."""
    widths = [max(1, max(r[1][d] >> 48 for r in rows) - min(r[1][d] >> 48 for r in rows)) for d in range(3)]

    def go(rows, first, owed):
        if owed == 1 or not rows:
            return {r[0]: first for r in rows}
        extents = [(max(r[1][d] >> 48 for r in rows) - min(r[1][d] >> 48 for r in rows)) / widths[d] for d in range(3)]
        d = extents.index(max(extents))
        line = sorted(rows, key=lambda r: r[1][d])
        fair = sum(r[2] for r in rows) / owed
        goal, before, i = fair * (owed // 2), 0, 0
        while i < len(line) - 1 and before + line[i][2] <= goal:
            before += line[i][2]
            i += 1
        for texts in (36, 24):
            own = [k for k, r in enumerate(line) if r[1][d] >> texts == line[i][1][d] >> texts]
            group, outside = sum(line[k][2] for k in own), sum(r[2] for r in line[: own[0]])
            if group <= sharding.SLACK * fair:
                i = own[-1] + 1 if goal - outside > group / 2 else own[0]
                break
        else:
            i += goal - before > line[i][2] / 2
        return go(line[:i], first, owed // 2) | go(line[i:], first + owed // 2, owed - owed // 2)

    return go(rows, 0, shards)


@pytest.mark.parametrize(("shards", "seed"), [(24, 1), (5, 2), (16, 3)])
def test_tree_equals_brute_force(spark, shards, seed):
    rng = random.Random(seed)
    texts = [f"{rng.randrange(10**6)} " * rng.randint(1, 60) for _ in range(700)]
    texts += [t for t in texts[:40] for _ in range(3)] + ["the same row"] * 30
    docs = table(spark, texts, [i if i < 820 else 5 for i in range(len(texts))])
    rows = sharding.cut(sharding.together(sharding.cut(sharding.points(docs), "test")), "test")
    tree = sharding.grow(rows, shards)
    given = rows.select("row", F.array(*[sharding.key_of(F.lit(d)) for d in range(3)]).alias("k"), "size", F.get(sharding.by_number(tree.first), tree.node()).alias("shard")).collect()
    assert slow_tree([(r.row, r.k, r["size"]) for r in given], shards) == {r.row: r.shard for r in given}


def test_repeated_rows_are_divided_evenly(spark):
    docs = table(spark, ["the same row " * 8] * 2000 + [f"row {k} " * 14 for k in range(2000)], [7] * 2000 + list(range(2000)))
    weight = sharding.shard(docs).toPandas().groupby("shard")["size"].sum()
    assert len(weight) == 24 and weight.max() < 1.02 * weight.mean() and weight.min() > 0.98 * weight.mean()


def test_equal_texts_stay_together(spark):
    """Copies in other languages and sources; only groups heavier than the slack may be divided."""
    rng = random.Random(4)
    texts = [f"text {k} " * rng.randint(1, 20) for k in range(9000)]
    docs = table(spark, texts + texts[::3], list(range(12000)))
    own = sharding.shard(docs).toPandas()
    assert (own.groupby(["size", "text_crc32"])["shard"].nunique() == 1).all()
    weight = own.groupby("shard")["size"].sum()
    assert weight.max() < 1.02 * weight.mean() and weight.min() > 0.98 * weight.mean()


def test_many_shards_make_no_large_plan(spark):
    docs = table(spark, [f"text {k}" for k in range(3000)])
    assert sharding.shard(docs, 1000).select("shard").distinct().count() > 950


def test_shards_of_odd_tables(spark, odd, none):
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.shard < 24 for r in rows)
    assert sharding.shard(none).count() == 0
    assert sharding.shard(odd, target_bytes=100_000).select("shard").distinct().count() <= 2


# --- op6


def vectors(spark, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "id long, vec array<float>")


def slow_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(ids[i], d[i]) for i in order]


def recall_of(got, ids, x, queries, k=10):
    by, hit, n = {}, 0, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    for q in queries:
        rows = sorted(by[int(ids[q])], key=lambda r: r["rank"])
        want = slow_nearest(ids, x, q, k)
        assert [r["rank"] for r in rows] == list(range(1, len(want) + 1))
        place = {int(i): j for j, i in enumerate(ids)}
        for r in rows:
            assert r.score == np.sqrt(((x[place[r.vec_id]] - x[q]) ** 2).sum())
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        hit, n = hit + len({r.vec_id for r in rows} & {int(i) for i, _ in want}), n + len(want)
    return hit / n


def test_recall_against_brute_force(spark):
    x, df = vectors(spark, 3000, 1)
    x = x.astype(np.float32).astype(np.float64)
    got = neighbours.search(df, F.col("id") % 100 == 0).collect()
    assert recall_of(got, np.arange(3000), x, range(0, 3000, 100)) >= 0.9


@pytest.mark.parametrize("sf_dir", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf_dir):
    given = spark.read.parquet(f"/root/testdata/{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows = [(r.id, r.vec) for r in given.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    got = neighbours.search(given, F.col("id") % 100 == 0).collect()
    assert recall_of(got, ids, x, np.flatnonzero(ids % 100 == 0)) >= 0.9


@pytest.mark.parametrize(("clusters", "most"), [(0, 0.25), (200, 0.05)])
def test_probes_prune(clusters, most):
    """Recall with the share of rows that are ranked exactly: on unrelated vectors, the hardest case,
    and on clustered ones."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))] + 0.5 * x
    q = np.arange(0, len(x), 400)
    shard = neighbours.Shard(np.arange(len(x)), x)
    found = shard.nearest(q, x[q], 10)
    hit = sum(len({int(i) for i in got[0]} & {i for i, _ in slow_nearest(np.arange(len(x)), x, j)}) for j, got in zip(q, found))
    assert np.mean([ranked for _, _, ranked in found]) < most * len(x)
    assert hit >= 0.9 * 10 * len(q)


@pytest.mark.parametrize("dim", [1, 2, 5, 64, 100, 300])
def test_probes_are_the_best_buckets(dim):
    rng = np.random.default_rng(dim)
    q, axes = neighbours.unit(rng.normal(size=(4, dim))), neighbours.axes_of(dim)
    y, z = neighbours.turned(q, 6), neighbours.turned(q, 7)
    assert np.allclose(y, neighbours.pseudo_rotation(q, 6), atol=1e-5) and np.allclose((y**2).sum(axis=1), 1, atol=1e-4)
    both = [np.stack([v, -v], axis=2).reshape(len(q), -1) for v in (y, z)]
    joint = (both[0][:, :, None] + both[1][:, None, :]).reshape(len(q), -1)
    probes = min(50, axes * axes)
    got = np.take_along_axis(joint, neighbours.probes_of(q, 3, probes), axis=1)
    assert np.allclose(np.sort(got, axis=1), np.sort(joint, axis=1)[:, -probes:], atol=1e-5)
    assert (joint.argmax(axis=1) == neighbours.buckets(q, 3)).all()


def test_small_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [3.0, 4.0]), (7, [3.0, 4.0]), (100, [1.0, 0.0]), (8, [1.0]), (200, []), (None, [1.0, 1.0]), (9, [1e-200, 1e-200]), (300, [1e200, 1e200])]
    got = neighbours.search(spark.createDataFrame(rows, "id long, vec array<double>"), F.col("id") % 100 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == [1, 100, 9, 7, 300] and by[100] == [0, 1, 9, 7, 300] and set(by) == {0, 100, 300}
    assert neighbours.search(spark.createDataFrame([], "id long, vec array<double>"), F.col("id") % 100 == 0).count() == 0


def test_equal_vectors_are_hot(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    x, _ = vectors(spark, 600, 2)
    x[200:] = x[200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in neighbours.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (200, 300, 400, 500):
        assert [v for _, v in sorted(got[q])] == [i for i in range(200, 212) if i != q][:10]


def test_one_id_with_many_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i if i % 3 else 7, rng.normal(size=8).tolist()) for i in range(1500)] + [(100, [1.0] * 8)] * 500
    got = sorted(neighbours.search(spark.createDataFrame(rows, "id long, vec array<double>"), F.col("id") == 100, sure=1.0).collect(), key=lambda r: r["rank"])
    own = min(v for i, v in rows if i == 100)
    best = {}
    for i, v in rows:
        if i != 100:
            best[i] = min(best.get(i, 9e9), float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())))
    assert [(r.score, r.vec_id) for r in got] == sorted((s, i) for i, s in best.items())[:10]


# --- op7


def test_language_of_odd_documents(spark, odd, none):
    net = language.train(table(spark, ["hello world and more"] * 30, range(100, 130)))
    assert net.languages == ["en"]
    rows = language.identify(odd, net).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[ODD_IDS.index(r.doc_id)]
        assert (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text)) and 0 <= r.score <= 1
    assert [p[0] for p in net.predict(["²½", "Ⅷ ① ٣", "_ 12", "é", "ª"])] == ["und", "und", "und", "en", "en"]
    assert language.identify(none, net).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    """A language with 30 of 6,000 documents has its share of a sample of 200."""
    docs = spark.createDataFrame([(i, f"zonk blart {i}" if i % 200 == 0 else f"hello world {i}", "xx" if i % 200 == 0 else "en") for i in range(6000)], "doc_id long, text string, lang string")
    x, y, languages = language.sample(docs, 200)
    assert languages == ["en", "xx"] and np.bincount(y)[1] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(0, 6000, 200)) and len(y) < 300


def test_windows_count_by_their_bytes():
    net = language.Network(["a", "b"], [], np.empty(0), np.empty((0, 2)), np.zeros(2))
    net.probabilities = lambda x, prepared: np.stack([(x[:, 0] == 97).astype(float), (x[:, 0] != 97).astype(float)], axis=1)
    assert net.predict(["a" * 256 + "b" * 256 + "a"], [None])[0] == ("a", 257 / 513)


def test_pooling_by_pairs_equals_plain_convolution():
    net = language.fit(np.random.default_rng(1).integers(0, 256, (200, language.WINDOW)).astype(np.uint8), np.arange(200) % 3, ["a", "b", "c"], epochs=1)
    x = np.random.default_rng(2).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    h = np.maximum(np.concatenate([g[0] for g in net.responses(x)], axis=1) + net.bias, 0)
    assert np.allclose(net.probabilities(x, net.prepared()), language.softmax(h @ net.out + net.out_bias), atol=1e-4)


def test_language_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.99


# --- op10


def slow_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for i in range(20_000):
        t = "".join(rng.choice("aB1023456789..@@-+ ()%é" if i % 3 else "0123456789 .-+") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == slow_spans(t), t
    assert pii.base_spans("0" * 9000 + ".1.1.1") == [(1, 0, 9006)]


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1(" * 60_000, "a@" * 50_000, "a" * 300_000 + " 1"])
def test_spans_of_long_texts_take_linear_time(text):
    pii.found_spans(text, pii.default_field())


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(3)
    own, pots, edges = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    p = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(own[i, y[i]] for i in range(4)) + sum(pots[e][y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(4):
            p[i, y[i]] += w
    assert np.allclose(pii.propagate(own, edges, pots, 60)[0], p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_skip_edges_carry_a_label():
    """An address without its domain takes the kind of its whole form, and none without it."""
    field = pii.default_field()
    text = "bob.smith@corp.example.com wrote, and bob.smith@corp answered"
    assert pii.as_text(pii.found_spans(text, field)[1]) == "email:0:26,email:38:52"
    assert pii.found_spans(text[27:], field)[1] == []
    cut = pii.Field(field.number, field.w, field.chain, np.zeros_like(field.skip))
    assert len(pii.found_spans(text, cut)[1]) == 1


#: Held-out sentences, none of them a template of training; <kind:span> marks personal data.
HELD_OUT = """Please ring our front desk, phone <phone:555-284-1907>, before nine.
You can dial <phone:(212) 664-7581> from anywhere.
The lab's fax <phone:0731 5024117> is out of paper.
Her cell <phone:646.203.9981> was off, so we sent mail to <email:j.doe@orbit>.
Meine Handynummer? Handy <phone:0176/4410982> bitte.
Telefon <phone:0761 2034981> ist das Sekretariat, Raum 4.12, Seite 310.
Sie erreichen den Rechner <ip:2001:db8:4:1:9:22:ff:41> nur von innen.
Ihre Karte <card:4539.5780.1234.5671> wurde belastet, Bestellung 8800412345.
Pour toute question, appelez <phone:01 44 27 62 10> le matin.
Notre tél. <phone:04 91 55 30 27> répond jusqu'à 18 h en 2023.
La carte bancaire <card:4539/5780/1234/5671> expire bientôt.
Llame <phone:934 512 876> antes del 12-5-2024 o escriba.
Su tarjeta <card:4539_5780_1234_5671> no es válida, factura 20240019.
El servidor <ip:fe80::9a3:4411> reinició la versión 4.2.1 dos veces.
Write ana.ruiz@delta.example.org; later ana.ruiz@delta replied to 41 people.
Call +1 (415) 555-0199 first and <phone:(415) 555-0199> afterwards.
El número +34 611 222333 y también <phone:611 222333> sirven.
A <phone:+1 (826) 555-4081> 190.137.223.204 B
We sold 3,400 units in 2019, order 77120345, ISBN 978-0-3064-0615-7.
Im Jahr 1998 kostete es 12.50, Rechnung 100-2345, Nummer 9807915762804491.
token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" and build v2.14.3
En 2021 la page 118 cite 3 auteurs, commande 5512087 du 14-02-2021.
The score was 21-18 at 20:45, and @fan42 posted #1234 about it.
En la página 77 hay 16 tablas y el pedido 6120045 de 1.500 euros.""".replace("later ana.ruiz@delta ", "later <email:ana.ruiz@delta> ").split("\n")


def test_held_out_sentences():
    """Spans that the field adds, on sentences in four languages: precision and recall by kind."""
    field = pii.default_field()
    right, added, wanted = collections.Counter(), collections.Counter(), collections.Counter()
    for marked in HELD_OUT:
        text, want, at = "", set(), 0
        for m in re.finditer(r"<(email|ip|card|phone):([^<>]*)>", marked):
            text += marked[at : m.start()]
            want.add((pii.KINDS.index(m[1]), len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += marked[at:]
        base, every = pii.found_spans(text, field)
        assert set(base) <= set(every)
        for s in set(every) - set(base):
            added[s[0]] += 1
            right[s[0]] += s in want
        for s in want - set(base):
            wanted[s[0]] += 1
    print(right, added, wanted)
    assert sum(right.values()) >= 0.9 * sum(added.values()) and sum(right.values()) >= 0.85 * sum(wanted.values())
    assert all(right[k] >= 0.5 * wanted[k] > 0 for k in range(4))


def test_shipped_personal_data_weights_are_the_learned_ones():
    learned, shipped = pii.fit(pii.labelled_documents()), pii.default_field()
    assert set(learned.number) == set(shipped.number)
    assert all(np.allclose(learned.w[i], shipped.w[shipped.number[k]], atol=1e-3) for k, i in learned.number.items())
    assert np.allclose(learned.chain, shipped.chain, atol=1e-3) and np.allclose(learned.skip, shipped.skip, atol=1e-3)


def test_pii_of_odd_documents(spark, odd, none):
    docs = odd.unionByName(table(spark, ["a.b@mail.example.com x 1.2.3.4, 4929348385146306 é +1 (017) 555-7713", "no data in 2024 here 3.14"], [50, 51]))
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    r = rows[50]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.spans == "email:0:20,ip:23:30,card:32:48,phone:51:68" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert rows[51].spans == rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs).count() == len(ODD) + 2 and pii.find(none).count() == 0
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert clean[50].text == "[EMAIL] x [IP], [CARD] é [PHONE]" and clean[50].n_chars == len(clean[50].text) and clean[0].text is None and clean[51].text == "no data in 2024 here 3.14"
    assert pii.redacted(docs).columns == docs.columns
