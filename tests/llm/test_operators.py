"""Every operator against brute force on small fixtures, with nulls, empty tables, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.check import compare
from gridloom.llm import bpe, decontaminate, html, langid, licenses, minhash, pii, quality, repeats, topk
from gridloom.llm.common import LOWER, NON_SPACE, Words
from gridloom.llm.components import components
from gridloom.llm.queries import ORACLES, QUERIES
from gridloom.llm.suffix import same_prefix, suffix_array

from ..conftest import SF

#: clashing names: helper columns of the operators
CLASH = "doc_id long, text string, id string, key string, node int, kept string, _pii_one int, _log_weight int, component_id int"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", 1, None, 2, 3, None) for i, t in rows], CLASH)


def noise(rng, n, alphabet="abcdé "):
    return "".join(rng.choice(alphabet) for _ in range(n))


# ---- shared parts


def test_words_and_hashes():
    texts = ["The  the\tTHE end", None, "", "é é x", "the"]
    w = Words(pa.array(texts), NON_SPACE, LOWER)
    h = w.hashes()
    assert w.per_row.tolist() == [4, 0, 0, 3, 1]
    assert h[0] == h[1] == h[2] == h[-1] and h[4] == h[5] and len(set(h.tolist())) == 4


def test_suffix_array_orders_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = np.append(rng.integers(0, rng.integers(1, 5) + 1, rng.integers(0, 60)), 0).astype(np.uint8)
        b = text.tobytes() + b"\0" * 200
        order = suffix_array(text, 128).tolist()
        assert sorted(order) == list(range(len(text)))
        assert all(b[x : x + 128] <= b[y : y + 128] for x, y in itertools.pairwise(order))
        common = same_prefix(text, np.array(order[:-1], int), np.array(order[1:], int), 20)
        for x, y, k in zip(order, order[1:], common):
            assert b[x : x + k] == b[y : y + k] and (k == 20 or b[x + k] != b[y + k])


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (4, 5), (2, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components(links.limit(0)).count() == 0


# ---- 1: repeats


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    block = [noise(rng, 150) for _ in range(4)]
    texts = [noise(rng, rng.randint(0, 400)) + rng.choice(block) + noise(rng, 50) + rng.choice(block)[: rng.randint(90, 150)] for _ in range(40)]
    texts += ["a" * 5000, "ab" * 800, texts[3], texts[3], "", None, "é" * 70, block[0][:99], block[0][:100], "x" * 99, noise(rng, 200000)]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    want = repeats.brute_force(rows)
    got = repeats.remove_repeats(odd(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        removed = sum(s["end"] - s["start"] for s in r["removed"])
        assert (r["n_bytes"], removed, len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]


def test_repeats_of_a_hot_gram(spark):
    rng = random.Random(8)
    phrase = "the same thirty bytes in all of"
    tail = [noise(rng, 120) for _ in range(5)]
    rows = [(k, noise(rng, 90) + phrase + (rng.choice(tail) if k % 3 == 0 else noise(rng, 90))) for k in range(1, 300)]
    rows += [(None, rows[40][1] + rows[60][1])]
    got = {}
    for bound in (2000, 1 << 30):
        cut = repeats.remove_repeats(docs_of(spark, rows), array_bytes=bound).collect()
        got[bound] = sorted((r["doc_id"] or -1, r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in cut)
    assert got[2000] == got[1 << 30] and len(got[2000]) == len(rows)
    want = repeats.brute_force([(repeats.LAST_ID if i is None else i, t) for i, t in rows])
    for i, n, removed, kept in got[2000]:
        expected = want[repeats.LAST_ID if i == -1 else i]
        assert (n, sum(e - s for s, e in removed), len(removed), hashlib.sha256(kept).hexdigest()) == expected


def test_hot_gram_sends_digests(spark):
    """No run of a substring beyond the bound sends its bytes to an array."""
    rng = random.Random(9)
    rows = [(k, 1, noise(rng, 90) + "the same thirty bytes in all of" + noise(rng, 90)) for k in range(300)]
    texts = spark.createDataFrame(rows, "oid long, key long, text string")
    found = repeats._repeated_runs(repeats._gathered(texts, 100, 24, 1), 100, 2000)
    places = found.groupBy("oid", "key").agg(F.collect_list(F.struct("start", "count", "kind", "hash")).alias("places"))
    runs = repeats._with_bytes(texts.join(places, ["oid", "key"]), 100)
    most = runs.filter(F.col("kind") == repeats.RUN).groupBy("hash").agg(F.sum(F.octet_length("bytes")).alias("n")).agg(F.max("n")).first()[0]
    assert (most or 0) <= 2000 and runs.filter(F.col("kind") == repeats.HOT).count() > 300


def test_repeats_edges(spark):
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(5, text), (5, text), (None, text), (7, None), (7, "")]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], len(r["removed"])) for r in repeats.remove_repeats(docs_of(spark, rows)).collect())
    n = len(text)
    assert got == [(0, n, 1), (5, n, 0), (5, n, 0), (7, 0, 0), (7, 0, 0)]


# ---- 2: near-duplicates


def near_brute(rows, words):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(sets), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [noise(rng, 4, "abcdefgh") for _ in range(300)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    base = [rng.choices(vocabulary, k=120) for _ in range(3)]
    # one large group whose members often miss each other, near the border on purpose
    rows = [" ".join(edited(base[0], rng.randint(0, 14))) for _ in range(150)]
    rows += [" ".join(edited(base[1], rng.randint(3, 9))) for _ in range(30)] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for _ in range(40)]
    rows += [rows[0], rows[0].upper(), rows[200], "one", "ONE", "", None, " \t ", "one two", "two one"]
    rows = list(enumerate(rows, 3))
    rng.shuffle(rows)
    for words in (2, 5):
        want = near_brute(rows, words)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(odd(spark, rows), words=words).collect()}
        assert got == want


def test_missed_pairs_keep_every_link(spark):
    """The difference filter alone, without a second turn, must not lose a link between members that miss the leader."""
    rng = random.Random(8)
    base = list(range(1000, 1060))
    sets = {0: base}
    for i in range(1, 60):
        family = random.Random(i % 7)
        s = [x for x in base if family.random() > 0.25] + [2000 + 100 * (i % 7) + k for k in range(family.randint(0, 12))]
        sets[i] = sorted({x if rng.random() > 0.03 else 5000 + rng.randrange(500) for x in s})
    jaccard = lambda x, y: 100 * (n := len(set(sets[x]) & set(sets[y]))) >= 80 * (len(sets[x]) + len(sets[y]) - n)
    rows = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    star = spark.createDataFrame([(0, i) for i in range(1, 60)], "c long, y long")
    linked = [(0, i) for i in range(1, 60) if jaccard(0, i)]
    labels = spark.createDataFrame([(0, 0), *[(i, 0) for _, i in linked]], "node long, component long")
    got = {(r["a"], r["b"]) for r in minhash._missed_pairs(star, labels, rows, 80, 4).collect()}
    inside = {0, *[i for _, i in linked]}
    want = {(x, y) for x, y in itertools.combinations(range(1, 60), 2) if jaccard(x, y) and not (x in inside and y in inside)}
    assert want and want <= got


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (800, 100, 100))
    s = minhash.sketches([np.concatenate((common, a)), np.concatenate((common, b)), common[:1], common[:0]], 200)
    assert (s[:3] != minhash.FULL).all() and (s[3] == minhash.FULL).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (1, None), (None, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (4, 4, True), (4, 4, True), (9, 4, False)]


# ---- 3: decontamination


def tiles_brute(item, text, minimum):
    """Longest common unmarked stretch first, by looking at all pairs of places."""
    free_a, free_b, out = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < minimum:
            return out
        for d in range(k):
            free_a[i + d] = free_b[j + d] = False
        out += k


def test_greedy_tiles_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        item, text = ([rng.randrange(1, 9) for _ in range(rng.randint(4, 40))] for _ in range(2))
        a, b = (decontaminate.Prints(np.array(x, np.uint64)) for x in (item, text))
        starts = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
        seeds = [j for j in range(len(text) - 2) if tuple(text[j : j + 3]) in starts]
        tiles = decontaminate.greedy_tiles(a, b, seeds, 3)
        assert all(item[i : i + k] == text[j : j + k] and k >= 3 for j, i, k in tiles)
        assert len({j + d for j, _, k in tiles for d in range(k)}) == len({i + d for _, i, k in tiles for d in range(k)}) == sum(k for *_, k in tiles)
        # ties may be broken another way, which can change the sum a little
        assert abs(sum(k for *_, k in tiles) - tiles_brute(item, text, 3)) <= 6


def test_decontamination_catches_reordered_passages(spark):
    passages = ["alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight", "red orange yellow green blue indigo violet"]
    item = ". ".join(passages)
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, f"{filler} {item} {filler}"),
        (2, f"{filler} {passages[2].upper()}! {filler} {passages[0]} x {passages[1]}"),
        (3, f"{filler} {passages[0]} {filler}"),
        (4, filler),
        (5, None),
        (6, ""),
        (1, item),
        (None, item),
    ]
    bench = spark.createDataFrame([(7, item, 1), (8, "too short", 2), (9, None, 3), (10, "", 4)], "item_id long, text string, doc_id int")
    found = sorted((r["doc_id"] or 0, r["item_id"], r["coverage"]) for r in decontaminate.contaminated(odd(spark, rows), bench).collect())
    assert found == [(0, 7, 1.0), (1, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0)]
    kept = decontaminate.drop_contaminated(odd(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and len(kept.columns) == 9
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    items = [(k, " ".join(noise(rng, 5, "abcdefgh") for _ in range(20))) for k in range(12)]
    docs = docs_of(spark, [(k, f"x y z {t} x") for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k, _ in items}
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


# ---- 4: html

PAGE = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="page has-sidebar">
<header>Head</header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><div class="cookie-notice">We use cookies, and this is a long notice about it all.</div>
<div class="layout with-sidebar"><article><h1>Title &amp; more</h1><p>First  <b>bold</b>
 text &lt;3 with enough words to count.<p>Second<br>line &#233;<ul><li>a point</li><li>another</ul><p>Be.</p>
<div class="ad">Buy!</div><form>Name <input></form><section id="comments"><p>reader: no, this is a rather long comment that nobody needs.</p></section></article>
<aside>Side</aside></div><!-- c --><footer>Foot &copy;</footer></body></html>"""


def test_main_text():
    want = "Title & more\nFirst bold text <3 with enough words to count.\nSecond line é\na point\nanother\nBe."
    assert html.main_text(PAGE) == want
    assert html.main_text(PAGE[: PAGE.index("</article>")]) == want  # unclosed
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<p>" * 5000 + "deep") == "deep" and html.main_text("<div>" * 5000 + "deep") == "deep"


def test_main_text_without_article():
    body = "<body><div id=menu><a href=1>one</a> <a href=2>two</a></div><div><div><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p></div></div><p class=footer>end</p></body>"
    assert html.main_text(body) == ("word " * 60).strip() + "\n" + ("more " * 40).strip()


def test_main_text_beside_an_article():
    story = ["alpha " * 60, "beta " * 50, "gamma " * 55, "delta " * 40, "omega " * 45]
    a, b, c, d, e = (x.strip() for x in story)
    links = "<ul>" + "".join(f"<li><a href=/{k}>Other page {k}</a></li>" for k in range(6)) + "</ul>"
    rest = f"{c}\n{d}\n{e}"
    parts = f"<main><article><p>{a}</p><p>{b}</p>{links}<p>So.</p></article><article><p>{c}</p><p>{d}</p></article></main><div>{links}</div><p>{e}</p>"
    want = f"{a}\n{b}\nSo.\n{rest}"
    assert html.main_text(f"<html><body>{parts}</body></html>") == html.main_text(parts) == want  # without a body tag too
    bare = f"<body><div>{e}<br>x <a href=1>y</a><article><div><p>{a}</p><p>{b}</p></div>{links}</article>{c} <b>{d}</b></div>{links}</body>"
    assert html.main_text(bare) == f"{e} x y\n{a}\n{b}\n{c} {d}"


@pytest.mark.parametrize("wrap", [
    '<div class="ad-free-content">%s</div>',
    '<div class="search-engine-history">%s</div>',
    '<form id="aspnetForm"><input value="x">%s<button>Go</button></form>',
    '<div class="sidebar"><div id="notice">%s</div></div>',
])
def test_furniture_names_around_an_article(wrap):
    story = "Some words of a long story about rivers. " * 20
    inner = f'<article><h1>Title</h1><p>{story}</p><section id="related-work"><p>Earlier rivers were studied.</p></section></article>'
    page = f'<html><body><nav><a href="1">Home</a></nav>{wrap % inner}<div class="comments"><p>nice post, thanks</p></div><footer>foot</footer></body></html>'
    assert html.main_text(page) == f"Title\n{story.strip()}\nEarlier rivers were studied."
    assert html.main_text(page.replace("article>", "div>")) == f"Title\n{story.strip()}\nEarlier rivers were studied."


def test_html_time_is_linear():
    import time

    def seconds(n):
        t0 = time.perf_counter()
        html.main_text("<p>words " + "</zz>" * n + "<div>" + "<b>" * n + "<p>y" * 20)
        return time.perf_counter() - t0

    seconds(2000)
    assert seconds(40_000) < 25 * max(seconds(4000), 0.02)


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, None), (2, "v", "", None)], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["url"] or "", len(r["text"])) for r in html.extract(pages).collect())
    assert got == [(0, "", 0), (1, "u", 94), (1, "u", 94), (2, "v", 0)] or got[1][2] == got[2][2] == len(html.main_text(PAGE))
    assert html.extract(pages.limit(0)).count() == 0


# ---- 5: top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = [(int(i), rng.integers(-30, 30, 12).tolist(), "e") for i in range(400)]
    vectors += [(500, [0] * 12, "z"), (501, vectors[3][1], "t"), (502, vectors[3][1], "t"), (3, vectors[3][1], "r"), (550, [1, -1], "short"), (None, [1] * 12, "n")]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>, score string")
    for shard, block in ((1000, 100), (37, 3)):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard, block_rows=block).collect()
        rows = {i: np.array(v + [0] * (12 - len(v))) for i, v, _ in vectors if i is not None}
        want = set()
        for q in rows:
            if q % 50 == 0:
                best = sorted((-int(rows[q] @ v), c) for c, v in rows.items() if c != q)[:5]
                want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_edges(spark):
    bad = [(50, [1.0, float("nan")]), (100, [None, 1.0]), (150, None), (200, [float("inf"), 1.0]), (0, [0.5, -0.5]), (1, [0.25, 0.0])]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>").filter(topk.usable("embedding")).select("vec_id", topk.quantised("embedding").alias("vector"))
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 1, 128 * 64)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


# ---- 6: personal data


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [
        (1, "Mr. John Smith met Anna Smith (anna.smith@Mail.example.com, +1 (017) 555-7713), call +1 017 555 7713."),
        (2, "Mr Smith ANNA.SMITH@MAIL.EXAMPLE.COM 4111 1111 1111 1111 or 4111-1111-1111-1111; 10.0.0.1, 078-05-1120"),
        (3, 'Frau Müller, г-н Иван Петров; token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" GB29 NWBK 6016 1331 9268 19'),
        (4, None),
        (5, ""),
        (6, "clean 12 text, 3.5.7 and 1999"),
        (2, "10.0.0.1"),
        (2, "10.0.0.1"),
        (None, "x@y.org"),
    ]
    clean, entities = pii.replace_pii(odd(spark, rows))
    out = sorted((r["doc_id"] or 0, r["text"]) for r in clean.select("doc_id", "text").collect() if r["text"] is not None)
    assert clean.count() == len(rows) and [c for c in clean.columns if c in CLASH] == odd(spark, []).columns
    text = {i: t for i, t in out if i in (1, 3, 6)}
    assert text[6] == rows[5][1] and (5, "") in out
    surname = re.match(r"Mr\. (\w+) (\w+) met (\w+) (\w+) \(", text[1])
    assert surname[2] == surname[4] != "Smith" and surname[1] in pii.GIVEN["m"] and surname[3] in pii.GIVEN["f"]
    second = next(t for i, t in out if i == 2 and t.startswith("Mr"))
    assert second.startswith(f"Mr {surname[2]} ")
    mail = re.search(r"\(([^,]+),", text[1])[1]
    assert mail.upper() in second and mail.endswith(".com") and "smith" not in mail.lower()
    phones = re.findall(r"\+1 [()0-9 -]{12,}[0-9]", text[1])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "(017)" not in phones[0]
    cards = re.findall(r"\d{4}(?:[ -]\d{4}){3}", second)
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1
    digits = [int(d) for d in re.sub(r"\D", "", cards[0])][::-1]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0  # still valid
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", second)[0]
    assert ip != "10.0.0.1" and [t for i, t in out if i == 2].count(ip) == 2
    assert not re.search("Müller|Петров|Иван|2abc3ff|6016|078-05", text[3] + second)
    assert re.search(r"г-н [А-Я][а-яё]+ [А-Я]", text[3]) and re.search(r'token = "[0-9a-f]{40}" GB', text[3])


def test_bare_mentions_get_the_same_surrogate(spark):
    rows = [
        (1, "Smith came. Dr. Jane Smith arrived. Smith said that Jane, SMITH and Smith's smith met Smithson; Jane left."),
        (2, "Smith and Jane without a title."),
        (3, "Herr O'Neill-Šmíd und г-н Петров. O'Neill-Šmíd, Петров. Dr. Brown's book: Brown"),
        (4, "write to a@b.example.org, Smith"),
    ]
    text = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs_of(spark, rows))[0].collect()}
    m = re.fullmatch(r"(\w+) came\. Dr\. (\S+) (\w+) arrived\. (\w+) said that (\S+), (\w+) and (\w+)'s smith met Smithson; (\S+) left\.", text[1])
    assert m[1] == m[3] == m[4] == m[7] != "Smith" and m[6] == m[3].upper() and m[2] == m[5] == m[8] != "Jane"
    assert text[2] == rows[1][1] and text[4].endswith(", Smith")
    m = re.fullmatch(r"Herr (\S+) und г-н (\w+)\. (\S+), (\w+)\. Dr\. (\w+)'s book: (\w+)", text[3])
    assert m[1] == m[3] != "O'Neill-Šmíd" and m[2] == m[4] != "Петров" and m[5] == m[6] != "Brown"


def test_surrogates_without_collisions(spark):
    parts = spark.createDataFrame([("given_m", f"name{i}") for i in range(150)] + [("surname", a + b) for a in "abcdef" for b in "abcdefgh"] + [("ip", f"10.0.0.{i}") for i in range(90)], "kind string, canon string")
    got = pii.surrogates(parts, "k").collect()
    assert len(got) == 288 and len({(r["kind"], r["surrogate"]) for r in got}) == 288
    assert not {(r["kind"], r["surrogate"]) for r in got} & {(r["kind"], r["canon"]) for r in got}
    assert {tuple(r) for r in pii.surrogates(parts, "k").collect()} == {tuple(r) for r in got} != {tuple(r) for r in pii.surrogates(parts, "other").collect()}


def test_pii_is_native(spark):
    plan = QUERIES["op6_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan += QUERIES["op7_licenses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.replace_pii(docs_of(spark, []))[0].count() == 0


# ---- 7: licenses


def licenses_brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    line = " " + " ".join(words) + " "
    found = []
    for k, rule in enumerate(licenses.rules()):
        if rule.keyword in words:
            for m in re.finditer(rule.regex, line):
                s = line[: m.start()].count(" ")
                found.append((s, -(s + m[0].count(" ")), rule.priority, rule.label, k, rule.base))
    found.sort()
    kept = [a for n, a in enumerate(found) if not any(b[2] <= a[2] and b[1] <= a[1] for b in found[:n])]
    base = [a for a in found if a[5]]
    starts = [a[0] for a in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({a[3] for a in base})), ",".join(sorted({a[3] for a in kept + base}))


def test_licenses_against_brute_force(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "CC-BY-NC 4.0 cc by cc by", "GNU General Public License v3.0 or later. All rights reserved. ALL RIGHTS RESERVED", "MIT license", "mit dem", "", None,
        "SPDX-License-Identifier: BSD-3-Clause", "Copyright (c) 2019 2020 x. Permission is hereby granted, free of charge, to any person obtaining a copy", "general public licenses", "ccby cc-by", "Ⅽ c by İcc by ſ cc by K",
        "creative commons attribution noncommercial share alike 3.0 unported license", "word " * 5000 + "all rights reserved",
    ]
    assert len(licenses.rules()) > 200
    rows = list(enumerate(texts)) + [(1, texts[1]), (None, texts[0])]
    got = licenses.summary(licenses.scan(odd(spark, rows))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {i: licenses_brute(t) for i, t in rows}
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == by_text[r["doc_id"]]
    assert licenses.summary(licenses.scan(docs_of(spark, []))).count() == 0


def licenses_ungated(text):
    """Labels by every rule's regular expression over the line, whatever the keywords say."""
    line = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
    found = []
    for k, rule in enumerate(licenses.rules()):
        for m in re.finditer(rule.regex, line):
            s = line[: m.start()].count(" ")
            found.append((s, -(s + m[0].count(" ")), rule.priority, rule.label, k, rule.base))
    found.sort()
    kept = [a for n, a in enumerate(found) if a[5] or not any(b[2] <= a[2] and b[1] <= a[1] for b in found[:n])]
    return ",".join(sorted({a[3] for a in kept}))


def test_license_gate_drops_no_match(spark):
    texts = ["GPLv3", "GPL3", "LGPLv2.1", "AGPLv3 or later", "MPL2.0", "Apache2", "gplv 3", "gplversion3", "gplverv3", "x gplv v2 y", "Permission to use, copy, modify, and/or distribute this software for any purpose", "gplv4", "odc-by1.0"]
    for _, _, short, versions in licenses.FAMILIES:
        for v in versions.split():
            texts += [f"{short}{a}{v}" for a in ("", "-", "v", " v", "v ", "-v", "ver", "ver.", "version", "version v", "vv")]
    expected = {i: licenses_ungated(t) for i, t in enumerate(texts)}
    assert expected[0] == "gpl-3" and expected[2] == "lgpl-2.1" and expected[4] == "mpl-2.0" and expected[10] == "isc" and not expected[11]
    got = licenses.summary(licenses.scan(docs_of(spark, enumerate(texts)))).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == expected


# ---- 8: language


def test_messages_pass_the_cuts_of_long_texts():
    """Overlapping chains against forward-backward over the whole text."""
    rng = np.random.default_rng(5)
    k, n = 3, 500
    field = langid.Field(["a", "b", "c"], np.zeros((4 << langid.GRAM_BITS, k)), np.zeros((1 << langid.LEXICON_BITS, k)), np.zeros(1 << langid.LEXICON_BITS, np.uint32), np.eye(k), rng.normal(size=k))
    field.grams[:] = rng.normal(size=field.grams.shape) * 0.3
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(m)) for m in (n, 1, 64, 65, 130)] + [None, ""]
    scan = langid.Scan(pa.array(texts, pa.string()))
    got, score = langid.word_posteriors(scan, field), langid.emissions(scan, field)
    step, start = np.exp(field.step), np.exp(field.start)
    for begin, size in zip(scan.words.row_start, scan.words.per_row):
        e = np.exp(score[begin : begin + size])
        ahead, back = e.copy(), np.ones_like(e)
        for t in range(size):
            ahead[t] *= ahead[t - 1] @ step if t else start
            ahead[t] /= ahead[t].sum()
        for t in range(size - 2, -1, -1):
            back[t] = step @ (e[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        want = ahead * back
        if size:
            assert np.abs(got[begin : begin + size] - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def test_language_sample_spends_its_places_on_usable_texts(spark):
    rows = [(i, None if i < 400 else "y" * 20000 if i < 800 else f"word{i}", "zz") for i in range(810)] + [(i, f"mot{i % 3}", f"l{i:03d}") for i in range(1000, 1230)]
    texts, langs = langid.sample(docs_of(spark, rows, "id long, text string, lang string"))
    assert sum(x == "zz" for x in langs) == 10 and len(set(langs)) == 231


def test_posteriors_against_all_paths():
    rng = np.random.default_rng(2)
    score, step, start = rng.normal(size=(1, langid.CHAIN, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    field = langid.Field(["a", "b", "c"], None, None, None, step, start)
    n = 5
    post, pairs = langid.posteriors(score, np.array([n]), field)
    weight = {}
    for path in itertools.product(range(3), repeat=n):
        weight[path] = np.exp(start[path[0]] + sum(score[0, t, path[t]] for t in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(path)))
    total = sum(weight.values())
    for t in range(n):
        for k in range(3):
            assert np.isclose(post[0, t, k], sum(w for p, w in weight.items() if p[t] == k) / total)
    assert np.isclose(pairs.sum(), n - 1)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    got = QUERIES["op8_langid"](spark, f"{SF}/../sf0.01").join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND n_chars > 100")
    assert got.filter("lang_pred = lang").count() / got.count() > 0.98


def test_language_edges_and_switching(spark):
    rng = random.Random(0)
    say = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "und der die das nicht schön über".split()}
    texts = [(k, " ".join(rng.choices(say[k], k=60))) for k in ("aa", "bb") for _ in range(40)]
    field = langid.fit([t for _, t in texts], [k for k, _ in texts])
    mixed = " ".join(say["aa"] * 4 + say["bb"] * 3)
    rows = [(1, "lorem dolor"), (2, None), (3, "12 — 34 …"), (4, ""), (None, "nicht über"), (6, mixed), (6, mixed)]
    got = [r for r in langid.identify(docs_of(spark, rows, "id long, text string"), field, with_words=True).collect()]
    lang = {r["id"]: r["lang"] for r in got}
    assert lang[1] == "aa" and lang[2] == lang[3] == lang[4] == "und" and lang[None] == "bb" and all(0 <= r["score"] <= 1 for r in got)
    words = next(r["words"] for r in got if r["id"] == 6)
    assert [w["lang"] for w in words] == ["aa"] * 24 + ["bb"] * 21
    assert langid.identify(docs_of(spark, rows, "id long, text string"), None).filter("lang <> 'und'").count() == 0
    assert langid.identify(docs_of(spark, [], "id long, text string"), field).count() == 0


# ---- 9: quality


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 100) for _ in range(3000)] + [5.0] * 500 + [-1e6]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 700, 1800, 3501):
        assert quality.kth_largest(df, k, bins=16, small=10) == sorted(values, reverse=True)[k - 1]


def test_quality_against_brute_force(spark):
    rng = random.Random(7)
    good = [(i, " ".join(rng.choices("the of and".split(), k=40))) for i in range(60)]
    bad = [(i, " ".join(rng.choice("xq zzz kkk".split()) + "!!" for _ in range(40))) for i in range(60, 80)]
    rows = good + bad + [(90, None), (91, ""), (None, "the of"), (5, good[5][1])]
    labels = spark.createDataFrame([(i, 1, "x") for i in range(0, 60, 2)] + [(i, 0, "x") for i in range(60, 80, 2)] + [(3, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    docs = odd(spark, rows)
    weigher = quality.fit(docs, labels)
    # the ratios, counted word by word
    fitted = {r["id"] for r in quality.label_sample(labels, 1000).filter("good AND NOT held_out").collect()}
    assert fitted < set(range(0, 60, 2)) and len(fitted) > 15
    buckets = len(weigher.ratio)
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        item, _ = quality.features(pa.array([t], pa.string()), buckets)
        np.add.at(raw, item, 1)
        if i in fitted:
            np.add.at(target, item, 1)
    want = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    assert np.allclose(weigher.ratio, want)
    scored, weight, key, bound = quality.resampled(docs, labels)
    got = scored.select("doc_id", weight.alias("w"), (key >= bound).alias("kept")).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: r["doc_id"] or -1), sorted(rows, key=lambda r: r[0] or -1)):
        item, _ = quality.features(pa.array([t], pa.string()), buckets)
        assert r["doc_id"] == i and np.isclose(r["w"], want[item].sum())
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & set(range(60, 80)) and len(kept & set(range(60))) >= 50
    assert quality.resampled(docs, labels.limit(0))[0].count() == len(rows)
    assert quality.resampled(docs.limit(0), labels)[0].count() == 0


def test_quality_rejects_bad_texts(spark):
    """With the labels of sf0.1 nearly all good texts stay and nearly all bad ones go."""
    labels = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op9_quality"](spark, f"{SF}/../sf0.1").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.997 and share[0] < 0.03


# ---- 10: byte-pair encoding


def test_bpe_round_trip_and_pieces(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path, public_tokenizers.PATTERN)
    rng = random.Random(9)
    long = " ".join(noise(rng, rng.randint(1, 12), "abcdé'1 \n漢!") for _ in range(4000))
    rows = [(1, "Hello world's end"), (2, None), (3, ""), (4, long), (4, long), (None, "😀<|endoftext|>"), (5, "a" * 3000), (6, "  x   y \n\n z  ")]
    got = bpe.encode_decode(odd(spark, rows), path, public_tokenizers.PATTERN, piece_chars=64).collect()
    want = {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["ids"], bytes(r["decoded"])) == want[r["doc_id"]]
    assert bpe.encode_decode(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", [
    " " * 3_000_000,
    "\n" * 3_000_000,
    "ab " + " \t\u3000\n" * 750_000 + "cd" + " " * 5000 + "\n",
    "x" + "\r\n" * 1_500_000 + " y z" + "\x1c" * 5000 + " end",
    " a\n" * 6000 + "\xa0" * 4096 + "'s" + " " * 4097 + "7",
], ids=["spaces", "newlines", "mixed", "crlf", "short"])
def test_bpe_long_white_space(text):
    """Match by match, as the pattern's rule says, each merged by itself."""
    import public_tokenizers
    import regex

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in enc._encode_single_piece(m[0])]
    got = bpe.encode_text(enc, text, 16384)
    assert got == want and enc.decode_bytes(got).decode() == text


# ---- registered queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and "pipeline" in entry.queries()
