"""Each operator against brute force on small tables with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmeter.llm import components, decontaminate, embeddings, html_text, langid, near_dedup, pieces, secret_scan, substring_dedup, toxicity, url_filter

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, component string")


EDGE = [None, "", " \n", "one", "One  two", "one two", "!!! ...", "é ß 日本", "a" * 5000, "w " * 3000]


def test_edges_do_not_crash(spark):
    d = table(spark, EDGE)
    n = len(EDGE)
    assert secret_scan.find_secrets(d).count() == n
    got = {r[0]: r[1:] for r in near_dedup.near_components(d, words=2).collect()}
    assert [got[i][0] for i in range(7)] == [0, 0, 0, 1, 1, 1, 1] and got[5] == (1, 4) and got[0] == (0, 0)
    assert substring_dedup.without_repeats(d).where("n_removed > 0").count() == 2
    model = langid.train(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r[1] for r in langid.identify(d, model).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r[1] for r in toxicity.score_texts(d, toxicity.train(d, labels)).collect()} == {0.0}
    assert pieces.encode_documents(d).where("not round_trip").count() == 0
    assert decontaminate.leaks(d, spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")).count() == 0
    none = d.limit(0)
    assert near_dedup.near_components(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0


def test_secrets():
    text = 'x Password: "hunter22" AKIA' + "A1" * 8 + " " + "0a" * 12 + " token=ab"
    assert secret_scan.joined(secret_scan.base_spans(text)) == f"assign:2:21,access:23:43,hex:44:68"
    key = "kJ8fQ2mZx7Lw9RtY4vBn"
    assert secret_scan.entropy_runs(key) == [(0, 20)] and secret_scan.added_spans("https/plain-words-only-here-and-there") == []
    assert key not in secret_scan.redact(f"use {key} now")


def test_entropy_equals_direct_count():
    s = "abc123DEF456ghi789JKL0mnoPQRstu"
    runs = secret_scan.entropy_runs(s)
    marked = set()
    for i in range(len(s) - 19):
        w = s[i : i + 20]
        p = np.array([w.count(c) for c in set(w)]) / 20
        if -(p * np.log2(p)).sum() >= 3.75 and re.search("[a-z]", w) and re.search("[A-Z]", w) and re.search("[0-9]", w):
            marked |= set(range(i, i + 20))
    assert {k for a, b in runs for k in range(a, b)} == marked


def test_near_duplicates_against_all_pairs(spark, docs):
    got = {r[0]: (r[1], r[2]) for r in near_dedup.near_components(docs, words=2).collect()}
    sets = {}
    for i, t in docs.select("doc_id", "text").collect():
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(lambda x: (x,), w))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert got == {i: (len(sets[i]), root(i)) for i in sets}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (None, 3), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    rows = [(i, (base[i % 60] + rng.normal(size=64) * (0.1 * (i // 60))).tolist(), int(i % 60) % 4) for i in range(180)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0][1], None), (904, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df).collect()}
    good = [r for r in rows if r[0] not in (900, 901, 902, 903)]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    want = dict(zip((r[0] for r in good), link.sum(1) - 1))
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0 and all(got[i] <= n for i, n in want.items())
    assert all(got[i] == 0 for i in (900, 901, 902, 903))


def covered(texts, length):
    """The bytes of each text that a string of that length, starting elsewhere too, covers."""
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                out[i][a : a + length] = True
    return out


def test_repeated_bytes_against_all_strings(spark):
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 101, 700).astype(np.uint8)).decode()
    fresh = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8)).decode()
    texts = [fresh(300) + passage + fresh(100), passage[100:650] + fresh(500), passage, passage, fresh(50) + "z" * 900, passage[:399], fresh(1200), passage[:420] + "é" + passage[420:], None, passage[:500] + passage[:500]]
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(table(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, c in enumerate(covered(raw, 400)):
        kept = np.frombuffer(raw[i], np.uint8)[~c].tobytes()
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(c.sum()), hashlib.sha256(kept).hexdigest()), i


def test_counting_path_equals_transform(spark, monkeypatch):
    rng = np.random.default_rng(6)
    passage = bytes(rng.integers(97, 123, 600).astype(np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, 200).astype(np.uint8)).decode() + passage[k:] for k in range(0, 60, 5)]
    want = sorted(map(tuple, substring_dedup.without_repeats(table(spark, texts)).drop("removed").collect()))
    monkeypatch.setattr(substring_dedup, "MANY", 2)
    assert sorted(map(tuple, substring_dedup.without_repeats(table(spark, texts)).drop("removed").collect())) == want


def test_pieces_equal_the_library(spark, docs):
    sp = pytest.importorskip("sentencepiece")
    codec = pieces.Codec(pieces.load())
    lib = sp.SentencePieceProcessor(model_file=pieces.MODEL)
    import pyarrow as pa

    texts = [*EDGE, " a  b ", " " * 200, "x" + " " * 97 + "y ", "\x00\x01é😀", "the▁mark"] + [r[0] for r in docs.select("text").limit(40).collect()]
    ids, at = codec.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t or ""), i


def code_length(text, training, order):
    """Bits of text under the contexts of the training texts, by following the escapes."""
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in t)
    counts = {}
    for t in map(fold, training):
        for i, c in enumerate(t):
            for m in range(order + 1):
                ctx = tuple(t[i - j] if i - j >= 0 else -1 for j in range(m, 0, -1))
                counts.setdefault(ctx, {}).setdefault(c, 0)
                counts[ctx][c] += 1
    total, s = 0.0, fold(text)
    for i, c in enumerate(s):
        for m in range(order, -2, -1):
            if m < 0:
                total += 8
                break
            at = counts.get(tuple(s[i - j] if i - j >= 0 else -1 for j in range(m, 0, -1)))
            if at is None:
                continue
            n, q = sum(at.values()), len(at)
            if c in at:
                total -= np.log2(at[c] / (n + q))
                break
            total -= np.log2(q / (n + q))
    return total


def test_code_lengths_against_brute_force():
    train = {"a": [b"the cat sat on the mat", b"A hat"], "b": ["der hut und die kuh".encode(), "für".encode()]}
    model = langid.Model(train, 2)
    texts = [b"the kuh", b"", b"Hat ", "für the".encode()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for block in (3, 1 << 19):
        got = model.lengths(data, at, block)
        for i, t in enumerate(texts):
            for k, lang in enumerate(model.langs):
                assert got[i, k] == pytest.approx(code_length(t, train[lang], 2), rel=1e-5), (t, lang)


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = langid.identify_held_out(d).where("held_out").join(d, "doc_id")
    assert x.where("lang = lang_pred").count() >= 0.97 * x.count()


def test_maximal_segments_against_all_segments():
    rng = np.random.default_rng(2)
    for _ in range(30):
        w = [(int(i), float(s)) for i, s in zip(sorted(rng.choice(40, 12, replace=False)), rng.choice([-3, -1, 1, 2, 4], 12))]
        full = np.full(41, -0.5)
        for i, s in w:
            full[i] = s - 0.5
        sums = np.concatenate([[0], np.cumsum(full)])
        best = max(sums[b] - sums[a] for a in range(41) for b in range(a + 1, 42))
        got = toxicity.maximal_segments(w, 0.5)
        assert max([s for _, _, s in got], default=0) == pytest.approx(max(best, 0))


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity.score_held_out(d, labels).where("held_out").join(labels, "doc_id")
    bad = x.where("toxic = 1")
    assert bad.where("predicted = 1").count() >= 0.9 * bad.count()
    assert x.where("toxic = 0 and predicted = 1").count() <= 0.02 * x.count()


def test_leaks_find_other_parameters(spark):
    item = "A train leaves Boston at 60 miles per hour and then Alice waits for 60 minutes before she takes another train to Boston at 45 miles per hour."
    same = item.replace("60", "75").replace("Alice", "Maria").replace("Boston", "Denver")
    torn = item.replace("at 60 miles", "at 75 miles")
    d = spark.createDataFrame([(1, "Intro here. " + item), (2, same + " More."), (3, torn), (4, "Nothing of the kind is said here at all, not one word of it."), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True}


def test_html():
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>menu</a></nav><div class='sidebar'>side, bar</div><article><h1>Head</h1><p>First, para &amp; more<br>line<p>Second <b>bo</b>ld, text that is long enough.</p><form>f</form></article><div id=comments><p>I, too, comment, a lot, here, now, and then.</p></div><footer>&copy; x</footer>"
    assert html_text.extract(page) == "Head First, para & more line Second bold, text that is long enough."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p>") == ""
    assert html_text.extract("<div><p>cut &am") == "cut &am"


def test_url_lists(spark):
    dated = spark.createDataFrame([("l", "block", "a.com", "add", "2024-01-10"), ("l", "block", "a.com", "remove", "2024-02-01"), ("m", "allow", "a.com/x", "add", "2024-01-01"), ("l", "block", None, "add", "2024-01-01")], "list string, kind string, rule string, action string, day string").withColumn("day", F.to_date("day"))
    cases = [("http://a.com/", "2024-01-09", "none"), ("http://a.com/", "2024-01-10", "block"), ("http://b.a.com:80/q", "2024-01-31", "block"), ("http://a.com/", "2024-02-01", "none"), ("http://A.com/x/y?z", "2024-01-15", "allow"), ("http://a.com/xy", "2024-01-15", "block"), ("http://aa.com/", "2024-01-15", "none"), (None, "2024-01-15", "none"), ("", None, "none")]
    rows = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id long, url string, day string").withColumn("day", F.to_date("day"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.verdicts(rows, dated, "url", "day").collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(cases)}
    empty = dated.limit(0)
    assert {r["verdict"] for r in url_filter.verdicts(rows, empty, "url", "day").collect()} == {"none"}


def test_pipeline_keeps_the_right_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = p.run(spark, DATA)
    rest = docs.where(docs.text.rlike("[^\\W\\d_]") | docs.text.rlike("\\p{L}"))
    near = near_dedup.near_components(rest, words=5).where("doc_id = component_id").select("doc_id")
    rest = rest.join(near, "doc_id", "left_semi")
    leak = [r[0] for r in decontaminate.leaks(rest, spark.read.parquet(f"{DATA}/benchmark.parquet")).select("doc_id").distinct().collect()]
    want = {r["doc_id"]: secret_scan.redact(r["text"]) for r in rest.collect() if r["doc_id"] not in leak}
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {i: sp.encode(t) for i, t in want.items()}


def leaking(spark, items, docs):
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in got.collect()}


def test_leaks_of_other_word_counts(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(40)]
    sold = "the shop sold 48 red apples to a man from Paris who paid for all of them with one old silver coin and left"
    docs = [" ".join([*w[:20], "extra", *w[20:]]), " ".join([*w[:13], "extra", *w[13:27], "more", *w[27:]]), " ".join(w[:20] + w[21:]), sold.replace("48", "1,200").replace("Paris", "New York"), " ".join(w[:18])]
    assert leaking(spark, [" ".join(w), sold], docs) == {(0, 0): False, (1, 0): False, (2, 0): False, (3, 1): True}


def test_leaks_of_items_that_are_mostly_placeholders(spark):
    item = "Compute 12 + 7, 30 - 4, 9 * 8 and 56 / 7"
    assert leaking(spark, [item], ["Now do this. " + item + " at once", item.replace("30", "31").replace("9", "2")]) == {(0, 0): False}


def test_leaks_with_names_that_begin_sentences(spark):
    item = "Alice has 5 apples. Bob has 3 apples. Alice gives 2 apples away. Bob eats 1 apple. How many are left?"
    copy = item.replace("Alice", "Maria").replace("Bob", "John").replace("5", "9")
    assert leaking(spark, [item], [copy, "Maria has no apples. John went home. How many people are there now?"]) == {(0, 0): True}


def test_near_duplicate_stage_keeps_rows_without_id_and_other_texts(spark):
    import corpus_pipeline as p

    w = [" ".join(f"{c}{chr(97 + i)}{chr(97 + i // 5)}" for i in range(20)) for c in "pqrst"]
    rows = [(None, w[0]), (None, w[1]), (None, w[1]), (1, w[2]), (1, w[2]), (2, w[3]), (2, w[4]), (3, w[2])]
    got = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted([(0, w[0]), (0, w[1]), (0, w[1]), (1, w[2]), (2, w[3]), (2, w[4])])


def test_secrets_of_every_class_mix():
    for key in ("key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "MZXW6YTBOI7Q2KJ5LRX3DHPN4VGA", "kQzWvXbNpLtRmYsHcJdFgTuAoEiKxVw", "zqxwvkjpmhtbrnlgydcfusoaie"):
        assert secret_scan.redact(f"use {key} now") == "use [SECRET] now", key
    long = "kJ8fQ2mZx7Lw9RtY4vBn" + "abcdeabcdeabcde/zzzzzzzz"
    assert secret_scan.redact(f"a {long} b") == "a [SECRET] b"
    assert secret_scan.redact("https/example/kJ8fQ2mZx7Lw9RtY4vBn is") == "[SECRET] is"
    for text in ("AKIAIOSFODNN/EXAMPLE7", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "550e8400-e29b-41d4-a716-446655440000", "2023/05/12/some-title-of-a-story", "Donaudampfschifffahrtsgesellschaft", "12345678901234567890"):
        assert secret_scan.added_spans(text) == [], text


def test_html_keeps_what_stands_beside_the_best_container():
    para = "<p>Some words of a paragraph, with a comma, that goes on for a while.</p>"
    for n in (2, 40):
        body = f"<p>Short lead.</p><div>{para * n}</div><ul><li>one</li></ul><h3>Three</h3><table><tr><td>cell</td></tr></table><pre>code</pre>"
        for page in (f"<body><nav>go</nav><article>{body}</article><footer>f</footer></body>", f"<body><div class=nav>go</div><div>{body}</div></body>", f"<body>{body}loose text</body>"):
            text = html_text.extract(page)
            assert text.startswith("Short lead. Some words") and "one Three cell code" in text and "go" not in text.split(), page
    assert html_text.extract(f"<body><ul><li><a href=x>menu</a></li></ul><div>{para * 3}</div><p>End.</p></body>").endswith("while. End.")
    assert "menu" not in html_text.extract(f"<body><ul><li><a href=x>menu</a></li></ul><div>{para * 3}</div><p>End.</p></body>")


def test_html_keeps_marked_articles_and_pages_of_loose_text():
    para = "<p>Some words of a paragraph, with a comma, that goes on for a while.</p>"
    for mark in ("post has-sidebar", "content no-sidebar", "with-comments", "page legal", "legal"):
        assert html_text.extract(f"<body><div class='{mark}'>{para}</div><div class=sidebar>side</div></body>") == para[3:-4], mark
    assert html_text.extract(f"<body><article>{para}</article><div class=comments>{para * 9}</div></body>") == para[3:-4]
    assert html_text.extract("<html><b>text</b>") == html_text.extract("text") == html_text.extract("<body><h2>text</h2></body>") == html_text.extract("<a href=x>text</a>") == "text"


def test_every_language_is_learned(spark):
    rows = [(i, f"aa{chr(97 + i // 26)}{chr(97 + i % 26)} " * 3, f"l{i:03}") for i in range(70)] + [(900, "zzz " * 30, "long")]
    model = langid.train(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string"), most_bytes=60)
    assert len(model.langs) == 71
    d = spark.createDataFrame([(1, "zzz zzz")], "doc_id long, text string")
    assert langid.identify(d, model).head()["lang_pred"] == "long"
