import hashlib
import random
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import bpe, components, entry, html, langid, linededup, mixing, quality, simhash, substrings, words
from tests.conftest import DATA

SPACE = " \t\n\x0b\x0c\r"


def ids(df, name="doc_id"):
    return sorted((r[name] is None, r[name] or 0) for r in df.collect())


@pytest.mark.parametrize("few", [0, 20, 200_000])
def test_components(spark, few):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5), (None, 3)] + [(1000, 1000 + i) for i in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([5, 1, 0, 7])
    e, a = rng.normal(size=(13, k)), np.exp(rng.normal(size=(k, k)))
    for chunk in (2, 3, 64):
        got, s = langid.forward_backward(e, lengths, a, chunk), 0
        for n in lengths:
            want = np.zeros((n, k))
            for y in product(range(k), repeat=int(n)):
                p = 1.0
                for t in range(n):
                    p *= np.exp(e[s + t, y[t]]) * (a[y[t - 1], y[t]] if t else a.sum(axis=0)[y[0]])
                for t in range(n):
                    want[t, y[t]] += p
            assert n == 0 or np.allclose(want / want.sum(axis=1, keepdims=True), got[s : s + n])
            s += n


def test_language_accuracy_and_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    texts = {r.lang: r.text for r in docs.where("n_chars > 400 and n_chars < 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = " ".join(texts["en"].split()[:25] + texts["de"].split()[:25])
    labels = [x for _, x in model.label_words(mixed)]
    assert sum(x == "en" for x in labels[:25]) > 18 and sum(x == "de" for x in labels[25:]) > 18


def test_long_words_count_whole():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    crf = langid.Features({long: 1})
    assert len(crf.of([long])[0]) > 6000 and len(crf.of([long[:-1]])[0]) == len(crf.of([long])[0]) - 3
    model = quality.fit([("good words here " + long, 1), ("bad " + long[::-1], 0)], buckets=1 << 12)
    assert (model.document_vectors([long]) != model.document_vectors([long[:64]])).any()
    values = lambda ws: np.array([[len(w)] for w in ws]).reshape(-1, 1)
    small, whole = words.WordTable(values, chars=5), words.WordTable(values)
    for texts in (["a bb ccc", None, ""], ["dddddddd bb e", "a"], [""]):
        (i, r), (j, t) = small.batch(texts), whole.batch(texts)
        assert [r[x].tolist() for x in i] == [t[x].tolist() for x in j] == [[[len(w)] for w in (s or "").split()] for s in texts]


def test_language_odd(odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (2, 3, 5, 6)) and by[None][0].held_out is False and by[7][0] == by[7][1]
    assert langid.identify(empty).count() == 0 and langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).count() == odd.count()
    kept = langid.accept(odd)
    assert kept.columns == odd.columns and not {2, 3, 5, 6} & {r.doc_id for r in kept.collect()}


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.quality == got.predicted).mean() > 0.95


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (6, 0), (5, None), (None, 1), (9, 7), (2, 1), (8, 1), (10, 0)], "doc_id long, quality int")
    got = quality.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_like_a_plain_scorer():
    """Document by document and word by word, with the same vectors."""
    texts = ["Good words and good words again again", "bad bad bad", "", None, "one", "ünder the sea 🙂 the sea", "a b " * 3000]
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts)], buckets=1 << 10, epochs=2)

    def plain(text):
        ws = (text or "").split()
        parts = []
        for w in [*ws, *[quality.REPEAT for a, b in zip(ws, ws[1:]) if a == b]]:
            found, _ = quality.features([w], 1 << 10)
            parts.append(sum(model.vectors[f].astype(float) for f in found) / len(found))
        for a, b in zip(ws, ws[1:]):
            (f,) = quality.bigrams(np.array([quality.word_hash(a), quality.word_hash(b)]), 1 << 10)
            parts.append(model.vectors[f].astype(float))
        z = (sum(parts) / len(parts) if parts else np.zeros(10)) @ model.output + model.bias
        return 1 / (1 + np.exp(z[0] - z[1]))

    assert np.allclose(model.score(texts), [plain(t) for t in texts], atol=1e-5)
    for text in texts:  # what is learned from is what is scored
        u, w = quality.bag(text, 1 << 10)
        assert np.allclose(w @ model.vectors[u], model.document_vectors([text])[0], atol=1e-5) and (not text or abs(w.sum() - 1) < 1e-4)


def test_quality_slopes():
    rng = np.random.default_rng(2)
    docs, output, bias, y, weight = rng.normal(size=(6, 4)), rng.normal(size=(4, 2)), rng.normal(size=2), rng.integers(0, 2, 6), rng.uniform(0.5, 2, 6)

    def loss():
        return -np.mean(weight * np.log(quality.softmax(docs @ output + bias)[np.arange(6), y]))

    for x, g in zip((output, bias, docs), quality.slopes(docs, output, bias, y, weight)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = loss()
            x[at] -= 2e-5
            assert abs((up - loss()) / 2e-5 * (6 if x is docs else 1) - g[at]) < 1e-6
            x[at] += 1e-5


def test_sample_is_bounded_and_even(spark):
    rows = [(i, "big") for i in range(4000)] + [(7, "big")] * 3000 + [(10_000 + i, "small") for i in range(30)] + [(20_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, lang string")
    got = Counter(r.lang for r in langid.sample(d, "lang", 50, 3).dropDuplicates().collect())
    assert got == {"big": 50, "small": 30} and langid.sample(d.limit(0), "lang", 50, 3).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var x="<article>no</article>";</script><style>p{{}}</style></head><body><header>Site head</header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="cookie notice">We use cookies</div><article><h1>Title {i}</h1><p>First  &lt;b&gt; line{i}<b> bold
<br><p>Second &#233;{i}</p><div class="comments"><p>a reader says {i}</p></div><form><input value="q">Send</form></article><aside>More</aside><footer>&copy; site</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"https://User@Host.example:80/{i}", PAGE.format(i=i)) for i in range(6)] + [(10, None, None), (11, "nonsense", ""), (12, "https://solo.example/", "<p>Only &amp; this"), (13, "https://cut.example/", PAGE.format(i=13)[:560]), (12, "https://solo.example/", "<p>Only &amp; this")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract_pages(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[3].text == "Title 3\nFirst <b> line3 bold\nSecond é3" and by[10].text == by[11].text == "" and by[12].text == "Only & this"
    assert html.extract_pages(pages.limit(0)).count() == 0


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(pages, **options):
    return {r.page_id: r.text for r in html.extract_pages(pages, **options).collect()}


def deduced(pages):
    (t,) = html.templates(pages).collect()
    return html.Template(t.n_pages, [tuple(x) for x in t.template])


def test_html_template_nests_classes(spark):
    pages = make(spark, [(i, "http://h.example/x", "<html><body><nav>" + f"<ul><li>a{i}</li></ul>" * (1 + i % 2) + f"</nav><div class=a><h1>Head {i}</h1>" + f"<p>text {i} of the page</p>" * (2 + i % 3) + "</div></body></html>") for i in range(12)])
    t = deduced(pages)
    # the frame stands once a page, the list's tokens once or twice, the paragraphs' two to four times
    kinds = {len({(r[2], r[3], r[4]) for r in c}) for c in t.classes}
    assert kinds == {1} and len(t.classes) == 3
    slots = dict(zip([max(r[2] for r in c) for c in t.classes], t.slot_of))
    assert len(t.slot_of) == 3 and t.main <= set(t.slot_of) and slots
    assert texts(pages)[4] == "Head 4\ntext 4 of the page\ntext 4 of the page\ntext 4 of the page"


def test_html_slots_end_with_the_frame(spark):
    """An article that its page leaves open ends where the template has its next container."""
    page = '<html><body><div class="top">Top {i}</div><article><h1>T{i}</h1><div>in {i} and more</div>{end}<div class="more">More {i}</div><section class="z">Other {i}</section></body></html>'
    pages = make(spark, [(i, "http://f.example/", page.format(i=i, end="" if i == 7 else "</article>")) for i in range(12)] + [(20, "http://f.example/", page.format(i=20, end="")[:93])])
    got = texts(pages)
    assert got[3] == "T3\nin 3 and more" and got[7] == "T7\nin 7 and more" and got[20].startswith("T20\nin 20")


def test_html_without_article_drops_what_repeats(spark):
    page = "<html><body><div>Same on all</div><div class=menu><a>x</a></div><p>Own {i} text</p></body></html>"
    assert set(texts(make(spark, [(i, "http://n.example/", page.format(i=i)) for i in range(8)])).values()) == {f"Own {i} text" for i in range(8)}


def test_html_the_template_decides(spark):
    """On pages whose tags and marks tell nothing the template finds the article; a page alone doesn't."""
    notice = "Please note that this site will be closed. " * 12
    page = '<div class="q1">{n}</div><div class="q2"><h1>Head {i}</h1><div class="q3"><p>' + "Body {i} of the text. " * 9 + "</p><p>{n}</p></div></div><div class=q4>Seen {i} times by {i} of our many readers all over the whole wide world</div>"
    rows = [(i, "http://t.example/", page.format(i=i, n=notice)) for i in range(9)]
    want = {i: f"Head {i}\n" + " ".join([f"Body {i} of the text."] * 9) for i in range(9)}
    assert texts(make(spark, rows)) == want and texts(make(spark, rows), most=0) == want
    assert html.extract(rows[0][2]) != want[0]


@pytest.mark.parametrize("swap", [{"article": "div class=k3"}, {"article": "div class=k3", "nav": "div class=z1", "footer": "div class=z2"}])
def test_html_of_renamed_tags(spark, duck, swap):
    """The driver's own pages with their telling tags and marks taken away, against the SQL on the pages as they are."""
    want = dict(duck.sql(html.SQL).df()[["page_id", "text"]].values.tolist())
    rows = duck.sql("SELECT page_id, 'http://one.example/' || page_id, html FROM pages").fetchall()
    for old, new in swap.items():
        rows = [(i, u, h.replace(f"<{old}>", f"<{new}>").replace(f"</{old}>", "</div>").replace('class="ad"', "class=q7")) for i, u, h in rows]
    assert texts(make(spark, rows)) == want


@pytest.mark.parametrize("page, text", [
    ("<p data-x=it's>Hello first.</p><p>Second don't vanish.</p><p>Third</p>", "Hello first.\nSecond don't vanish.\nThird"),
    ('<p title="a>Hello</p>', "Hello"), ('<p title="a>Hello</p><p class="x">World</p>', "Hello\nWorld"), ('<p title="a > b"class=c>One</p><i href="x">two</i>', "One\ntwo"),
    ('<article><p>One</p><p class="advert">Buy</p><ul class="related"><li>R</li></ul><p>x <span class="ad">Buy <span>it</span> now</span> y</p><p class="comment">C</p></article>', "One\nx y"),
    ('<article><section id="related-work"><p>Work</p></section><div class="share-price">12</div><div class="comments-list">no</div></article>', "Work\n12"),
    ("<article><p>a<li>b<li>c</article><p>d", "a\nb\nc"), ("<title>No</title><p>AT&amp;T &amp more &#x41;&nbsp;&lt;b&gt;", "AT&T & more A <b>"), ("<script>if (a</script><p>x", "x"),
    ("<p>" + "long " * 400_000 + "</p><textarea>no</textarea>", ("long " * 400_000).strip()), ("<svg><p>kept", "kept"), ("", ""), (None, ""), ("< 3 and <", "< 3 and <"), ("<p>a<br>b<!-- c", "a b")])
def test_html_markup(page, text):
    assert html.extract(page) == text


def test_targets_against_resharing(spark):
    rng = random.Random(4)
    for trial in range(4):
        sizes = {f"s{i}": rng.choice([0, 5, 50, 500, 5000]) for i in range(7)} | {None: 40}
        names = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, capped = 1.5 * sum(sizes.values()), set()
        while True:
            rest = total - sum(2 * sizes[s] for s in capped)
            w = sum(weight[s] for s in names if s not in capped)
            want = {s: 2 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
            over = {s for s in names if s not in capped and want[s] > 2 * sizes[s] + 1e-9}
            if not over:
                break
            capped |= over
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 for s in names), (trial, got, want)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000):
        d = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("p"))
        got = [r.p for r in d.collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.taken_words(docs).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (got["size"] == [len(t.split()) for t in got.text]).all() and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.said).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1 and ((by.taken - by.target).abs() <= mixing.BLOCK + 1).all()
    again = mixing.taken_words(docs.repartition(7)).toPandas().set_index("doc_id").taken
    assert (again[got.doc_id].to_numpy() == got.taken.to_numpy()).all()
    texts = mixing.mixed_texts(docs).toPandas()
    words = Counter()
    for r in texts.itertuples():
        words[r.doc_id] += len(r.text.split())
    assert all(words[r.doc_id] == r.taken for r in got.itertuples()) and (texts.n_chars == texts.text.str.len()).all()


def test_mixing_odd(odd, empty):
    got = mixing.taken_words(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0
    assert mixing.mixed_texts(odd).columns == odd.columns


def test_clashing_names_pass_through(spark):
    rows = [(i, f"some words of text number {i}\na shared line of text", "ab"[i % 2], 99, "x", 7, 5, 3) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, runs string, n int, pass int, n_dropped int")
    for out in (mixing.mixed_texts(d), linededup.dedup_documents(d)):
        assert out.columns == d.columns and {(r.n_lines, r.runs, r.n, r["pass"], r.n_dropped) for r in out.collect()} == {(99, "x", 7, 5, 3)}


def test_bpe_like_the_library(spark, odd, empty):
    path = P.path(bpe.VOCABULARY)
    c = bpe.Codec(path, P.PATTERN, cache=500)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(1)
    part = ["a", "e", "th", " ", "\n", "\x1c", "\x85", "é", "ß", "漢", "🙂", "1", "²", "'s", "!", "　", "the", "\t", "ñ", "A", "<|endoftext|>"]
    texts = ["".join(rng.choice(part) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["ab" * 20_000, "é漢" * 2000, None, ""]
    got = c.encode_batch(texts)
    assert all(g == (own.encode_ordinary(t) if t else []) and c.decode(g) == (t or "").encode() for g, t in zip(got, texts))
    for r in [r for r in bpe.tokenize(odd, path, P.PATTERN, ids=True).collect()]:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(own.decode_bytes(r.ids)).hexdigest()
    assert bpe.tokenize(odd, path, P.PATTERN).count() == odd.count() and bpe.tokenize(empty, path, P.PATTERN).count() == 0


def test_bpe_trees_agree():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 260}
    pairs, single = bpe.Pairs(ranks), np.arange(256)
    pieces = ["".join(s).encode() for n in range(2, 8) for s in product("abc", repeat=n)]
    pieces = [p for p in pieces if p not in ranks]
    assert [x.tolist() for x in bpe.encode_many(pieces, single, pairs)] == [bpe.encode_piece(p, ranks) for p in pieces]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_like_sql(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(linededup, "LINES_A_SALT", 3 if seed else linededup.LINES_A_SALT)
    assert seed == 0 or linededup.salts_for(300, 64) == 164
    part = ["Élan vital des", "ABC def ghi jkl", " \t", "ⒶⒷ circled letters", "ΣΑΣ final sigma", " x", "\n", "\n", "\n", "İstanbul DOTTED", "short", "\r"]
    rows = [(i, "".join(rng.choice(part) for _ in range(rng.randrange(9))) if rng.random() > 0.05 else None) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {tuple(r) for r in linededup.dedup_lines(d).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()}
    c = duckdb.connect()
    c.register("documents", __import__("pandas").DataFrame(rows, columns=["doc_id", "text"]))
    assert got == {tuple(r) for r in c.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({linededup.SQL})").fetchall()}


def test_line_dedup_odd(odd, empty):
    got = linededup.dedup_lines(odd)
    assert got.count() == odd.count() and linededup.dedup_lines(empty).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert by[8].n_dropped == 1 and by[8].text == "" and by[7].n_dropped == 0 and by[2].n_lines == 1 and by[2].text == ""
    assert linededup.dedup_documents(odd).columns == odd.columns


def test_simhash_like_brute_force(spark, odd):
    def brute(text):
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))

    rng = random.Random(6)
    base = [" ".join(rng.choice(["Ab", "cd", "ÉF", "g"]) for _ in range(rng.randrange(0, 7))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    fp = [brute(t) for t in base]
    assert all(got[i].fp % 2**64 == fp[i] for i in range(80))
    label = list(range(80))
    for _ in range(80):
        for i in range(80):
            label[i] = min(label[j] for j in range(80) if (fp[i] ^ fp[j]).bit_count() <= 2)
        label = [min(label[j] for j in range(80) if label[j] == label[i] or (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(80)]
    assert [got[i].component_id for i in range(80)] == label
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == odd.count() and {x.component_id for x in r if x.doc_id in (2, 3, 5)} == {2}


def test_simhash_links_are_all_found(spark):
    rng = random.Random(8)
    near = []
    for _ in range(60):
        x = rng.getrandbits(64)
        near += [x] + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(5)]
    near = sorted(set(near))
    d = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(near)], "fp long, rep long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.links(d).collect())
    assert got == [(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if (near[i] ^ near[j]).bit_count() <= 2]


def test_simhash_keeps_one(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and 8 not in {r.doc_id for r in kept.collect()} and {1, 2, 7} <= {r.doc_id for r in kept.collect()}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_chunks_are_local():
    rng = random.Random(3)
    data = bytes(rng.randrange(97, 123) for _ in range(5000))
    a, b = substrings.chunk_ends(data), substrings.chunk_ends(b"inserted" + data)
    assert a[-1] == 5000 and (np.diff(a) > 0).all()
    assert set((a + 8).tolist()) - set(b.tolist()) <= set((a[a < 9] + 8).tolist())


def test_long_chunks_are_cut_in_step():
    cut = lambda data: [data[x:y] for e in [substrings.chunk_ends(data).tolist()] for x, y in zip([0, *e], e)]
    word = b"never " * 300
    a, b = cut(b"x. " + word), cut(b"another start; " + word)
    assert b"".join(a) == b"x. " + word and max(map(len, a + b)) <= substrings.MOST
    assert len(set(a[4:-1])) == 1 and a[4] in b[2:-1]


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = text(90)
    rows = [(i, text(60) + (" " + shared + " " if i in (3, 17, 30) else " ") + text(40)) for i in range(40)]
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {3, 17, 30} and {r.doc_id for r in got if r["first"]} == {3}
    for r in got:
        passage = rows[r.doc_id][1].encode()[r.start : r.start + r["size"]].decode()
        assert passage in shared and len(passage.split()) >= 60 and abs(r.n_words - len(passage.split())) <= 1
    assert {r.doc_id for r in substrings.repeated_passages(odd).collect()} <= {4, 9} and substrings.repeated_passages(empty).count() == 0


def test_passages_of_repeated_ids(spark):
    """Each text of a document counts, and is read at its own places."""
    rng = random.Random(9)
    a, b = (" ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9))) for _ in range(80)) for _ in range(2))
    rows = [(1, a), (1, b), (1, b), (2, "x " + a + " y"), (3, "z " + b), (4, "w")]
    got = {(r.doc_id, r.other_doc_id) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2), (1, 3), (2, 1), (3, 1)}
    assert substrings.repeated_passages(spark.createDataFrame([(1, a), (1, a + " " + b)], "doc_id long, text string")).count() == 0


def test_passages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, (r.text or "").split()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]

    def sharing(n):
        seen, found = {}, set()
        for doc, ws in texts:
            for i in range(len(ws) - n + 1):
                other = seen.setdefault(hash(tuple(ws[i : i + n])), doc)
                if other != doc:
                    found |= {doc, other}
        return found

    got = {r.doc_id for r in entry.op8_substrings(spark, sf).collect()}
    want = sharing(51)
    assert len(want) > 100 and len(want - got) <= len(want) * 0.01
    assert len(got - sharing(25)) <= len(want) * 0.02


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    mixed = spark.read.parquet(str(tmp_path / "3")).collect()
    want = Counter((r.doc_id, len(own.encode_ordinary(r.text))) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens) for r in docs.collect()) == want


@pytest.mark.parametrize("name", ["op4_mixing", "op8_substrings"])
def test_registered(spark, name):
    assert entry.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_same_as_sql(spark, duck, name):
    from tests.test_queries import rows

    got, want = entry.QUERIES[name](spark, DATA).toPandas(), duck.sql(entry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)
