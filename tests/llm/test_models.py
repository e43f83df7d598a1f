"""Quality, page text, lattice scores, url verdicts and nearest neighbours."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rarelane.llm import urls
from rarelane.llm.html import cut, main_text, main_texts
from rarelane.llm.lattice import Lattice, text_scores, vocabulary
from rarelane.llm.neighbours import nearest
from rarelane.llm.quality import descend, drop_low_quality, features, fit, quality_scores, ratios, scores
from rarelane.llm.queries import URL_RULES
from tests.llm.conftest import ODD, prose, rows_of

FOLDER = "/root/testdata/sf0.01"


# --- quality ---------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in scored) / len(scored)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in scored)
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_features_are_the_distinct_ngrams_of_each_text():
    texts = ["a b a b", "", "x", "THE!! the!! the", prose(3, 500), "a b a b"]
    ends, places = features(texts)
    own = np.split(places, ends[:-1])
    assert [len(o) == len(set(o.tolist())) for o in own] == [True] * 6
    assert len(own[1]) == 0 and own[0].tolist() == own[5].tolist() and len(own[0]) >= 4
    alone = features(texts[4:5])[1]
    assert alone.tolist() == own[4].tolist()


def test_ratios_and_descent():
    ends, places = np.array([2, 4, 6]), np.array([1, 2, 1, 3, 2, 3], np.int32)
    r = ratios(ends, places, np.array([1, 1, 0]))
    ones, zeros = Counter([1, 2, 1, 3]), Counter([2, 3])
    size = len(r)
    for at in (1, 2, 3, 4):
        want = math.log((1 + ones[at]) / (size + 4)) - math.log((1 + zeros[at]) / (size + 2))
        assert r[at] == pytest.approx(want)
    w = descend(np.array([1, 2]), np.array([0, 1], np.int32), np.array([1.0, 1.0]), np.array([1.0, -1.0]))
    assert w[[0, -1]].sum() > 0 > w[[1, -1]].sum()


def test_quality_without_two_classes():
    for labels, share in (([], 0.5), ([1, 1, 1], 0.8), ([0], 1 / 3)):
        model = fit(["some text"] * len(labels), np.array(labels, np.int64))
        assert scores(["a", ""], model).tolist() == pytest.approx([share, share])


def test_quality_of_edge_rows(spark, edge_docs, edge_texts, no_docs):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 0, 0), (9, 0, 1), (10, 1, 0), (None, 1, 0), (8, None, 0), (999, 0, 0), (7, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = quality_scores(edge_docs, labels).collect()
    assert len(rows) == len(edge_texts) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert drop_low_quality(edge_docs, labels).columns == edge_docs.columns
    assert quality_scores(no_docs, labels).count() == 0 and drop_low_quality(no_docs, labels).count() == 0
    assert {r.score for r in quality_scores(edge_docs, labels.limit(0)).collect()} == {0.5}


# --- page text -------------------------------------------------------------------------------


def test_cut_is_the_least_labelling():
    r = random.Random(0)
    for _ in range(150):
        n = r.randint(1, 8)
        s = [r.uniform(-3, 3) for _ in range(n)]
        e = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(label):
            own = sum(max(0, x) if not y else max(0, -x) for x, y in zip(s, label))
            return own + sum(w for a, b, w in e if label[a] != label[b])

        least = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(cut(s, e)) == pytest.approx(least)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p", ""), ("<!-- x", ""), ("<script>var a = '<p>Text of a script.</p>';</script>", ""),
    ("<article><header><h1>T</h1></header><p>x &amp; y&nbsp;z<br>w</p>"
     "<section class='reader-comments'><p>A comment, quite long, by a reader.</p></section>"
     "<form>Sign up <input></form><!-- c --><p>End</article><div class='cookie-notice'>We use cookies.</div>",
     "T\nx & y z w\nEnd"),
    ("<body class='has-sidebar'><div id='header'><a href=x>Home</a></div><div class='with-sidebar'><h1>Title here</h1>"
     "<p>Some long paragraph of text that is content, with many words in it.</p><p>Short.</p></div>"
     "<aside>Side text long enough to be read as a sentence.</aside><footer>Imprint and more words here.</footer>",
     "Title here\nSome long paragraph of text that is content, with many words in it.\nShort."),
])
def test_main_text(page, text):
    assert main_text(page) == text


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = main_texts(pages).collect()
    assert len(rows) == len(html)
    from html import unescape

    for r in rows:
        inside = re.search("(?s)<article>(.*)</article>", html[r.page_id])[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_of_edge_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1), (2, None, "<p>" + "word " * 50_000, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(main_texts(pages).collect(), key=str)
    assert [len(r) for r in got] == [4] * 4 and max(r.n_chars for r in got) == 249_999
    assert main_texts(pages.limit(0)).count() == 0


# --- lattice scores --------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b" ab", b"bab", b"ba"]
    p = np.array([0.05, 0.1, 0.1, 0.2, 0.15, 0.2, 0.1, 0.1])
    weight = dict(zip(pieces, p))

    def total(text):
        if not text:
            return 1.0
        return sum(weight.get(text[:i], 0) * total(text[i:]) for i in range(1, len(text) + 1))

    def uses(text, piece):
        """Expected uses, from all segmentations written out."""
        def ways(rest):
            if not rest:
                yield 1.0, 0
            for i in range(1, len(rest) + 1):
                if rest[:i] in weight:
                    for w, n in ways(rest[i:]):
                        yield w * weight[rest[:i]], n + (rest[:i] == piece)
        return sum(w * n for w, n in ways(text)) / total(text)

    words = [b"ab", b"abab", b"b", b"babab", b"ab", b"aaaa"]
    lattice = Lattice(pieces, np.log(p))
    assert lattice.scores(words) == pytest.approx([math.log10(total(b" " + w)) for w in words])
    want = [sum(uses(b" " + w, piece) for w in words) for piece in pieces]
    assert lattice.expect(words) == pytest.approx(want)


def test_words_of_the_vocabulary_sum_to_at_most_one():
    pieces, logs = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.exp(logs).sum() == pytest.approx(1) and len(set(pieces)) == len(pieces)
    assert {bytes([b]) for b in range(256)} <= set(pieces)
    assert np.isfinite(Lattice(pieces, logs).scores([b"", b"x" * 3000, "日本\U0001f600".encode(), b"\xff\x00"])).all()


def test_base_scores(spark, edge_docs, edge_texts, no_docs, monkeypatch):
    monkeypatch.setattr("rarelane.llm.lattice.HEAD", 5)  # the other words are joined
    rows = text_scores(edge_docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    low = [(k, [w.decode() for w in (t or "").encode().lower().split()]) for k, t in edge_texts]
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in low]
    counts, texts = Counter(), 0
    for (_, words), out in zip(low, held):
        if not out:
            counts.update(words)
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    want = []
    for (k, words), out in zip(low, held):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((texts + 1) / (n + v + 1))
        want.append((str(k), out, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want) and all(r.score < 0 for r in rows)
    assert text_scores(no_docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_known_words_and_their_rest_share_all_weight(spark, make_docs):
    docs = make_docs([(1, "aa bb aa"), (3, "cc")])
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in text_scores(docs, model).collect()}
    # N = 6 with two ends, three known words: the end has 2/6, a word (c - d)/6 and its share of 3d/6
    end = math.log10(2 / 6)
    assert got[3].score - end > math.log10(0.25 / 6) and got[3].score - end < math.log10((0.25 + 3 * 0.75) / 6)


# --- urls ------------------------------------------------------------------------------------


def plain_url(url):
    m = re.match("(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules(spark):
    cases = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/1",
        "http://example.com", "http://a.net/es/", "http://net/fr/x", "http://anet/fr/", "x://y://z/w",
        "http://sub.www.example.com/en/", "http://example.com?x/en/", "http://É.com/", "http://a.com/\n/b",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, purity string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in urls.url_verdicts(pages, labels, URL_RULES).collect()}
    assert len(rows) == len(cases)
    for i, url in enumerate(cases):
        host, path, rule, verdict = plain_url(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or "allow")


def test_templates_against_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(urls, "SUPPORT", 3)
    monkeypatch.setattr(urls, "STRENGTH", 1.0)
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        section = r.choice(["good", "spam", "mixed"])
        slug = "".join(r.choice("abcdef") for _ in range(6))
        rows.append((i, f"http://h.org/{section}/{slug}/{i}"))
        bad = {"good": 0.0, "spam": 0.95, "mixed": 0.3}[section]
        if r.random() < 0.7:
            labels.append((i, 0 if r.random() < bad else 1, 0))
    rows.append((900, "http://other.org/" + "/".join("abcdefghijklmnop")))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels + [(None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x.page_id: x for x in urls.url_verdicts(pages, known, URL_RULES).collect()}
    assert len(got) == len(rows)
    bad = {k: 1 - q for k, q, _ in labels}
    share = sum(bad.values()) / len(bad)
    for section, verdict in (("good", "allow"), ("spam", "block"), ("mixed", "allow")):
        own = [k for k, u in rows if f"/{section}/" in u]
        found = [bad[k] for k in own if k in bad]
        purity = (sum(found) + share) / (len(found) + 1)
        for k in own:
            assert got[k].template == f"/{section}/*/{{n}}" or section == "mixed"
            assert got[k].verdict == verdict
            if got[k].template == f"/{section}/*/{{n}}":
                assert got[k].purity == pytest.approx(purity)
    assert got[900].template.endswith("/**")


def test_urls_stay_in_the_jvm(spark):
    pages, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("pages", "labels"))
    df = urls.url_verdicts(pages, labels, URL_RULES)
    assert not re.search("Python|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert urls.url_verdicts(pages.limit(0), labels, URL_RULES).count() == 0
    assert urls.url_verdicts(pages, labels.limit(0), URL_RULES).where("rule IS NULL AND verdict = 'block'").count() == 0


# --- nearest neighbours ----------------------------------------------------------------------


def exact(rows, count=20):
    """rows: id -> vector."""
    out = {}
    for q, x in rows.items():
        if q % 20 == 0:
            scored = sorted((-float(np.dot(x, y)), k) for k, y in rows.items() if k != q)
            out[q] = scored[:count]
    return out


def test_recall(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    got = {}
    for r in nearest(vectors).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    want = exact(rows)
    assert set(got) == set(want)
    hits = sum(len({k for _, k in want[q]} & {r.vec_id for r in got[q].values()}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, own in got.items():
        assert sorted(own) == list(range(1, len(own) + 1))
        for r in own.values():
            assert r.score == pytest.approx(float(rows[q] @ rows[r.vec_id]), abs=1e-12)


def test_copies_ties_and_bad_vectors(spark):
    r = random.Random(6)
    one = [1.0, 0.0, 0.0]
    data = [(i, one, "x") for i in range(0, 60)]
    data += [(i, [r.gauss(0, 1) for _ in range(3)], "x") for i in range(60, 75)]
    bad = [(80, None), (100, []), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [float("nan"), 1.0, 0.0]),
           (120, [float("inf"), 0.0, 0.0]), (104, [1.0, 2.0]), (None, one)]
    data += [(k, v, "x") for k, v in bad] + [(60, data[60][1], "again")]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    rows = {k: np.array(v) for k, v, _ in data[:75]}
    got = {}
    for x in nearest(vectors).collect():
        got.setdefault(x.query_id, []).append((x.rank, -x.score, x.vec_id))
    want = exact(rows)
    assert set(got) == set(want)
    for q in want:
        own = sorted(got[q])
        assert [k for *_, k in own] == [k for _, k in want[q]]
        assert [s for _, s, _ in own] == pytest.approx([s for s, _ in want[q]])


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])], kind)
    got = {(r.query_id, r.rank): r.vec_id for r in nearest(few).collect()}
    assert got == {(0, 1): 1, (0, 2): 20, (20, 1): 0, (20, 2): 1}
    assert nearest(spark.createDataFrame([(20, [1.0, 2.0])], kind)).count() == 0
    assert nearest(few.limit(0)).count() == 0
