"""Periodic runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rarelane.llm import periods
from rarelane.llm.periods import Words, kept_words, periodic_runs, strip_fragments, tiles, z_function
from rarelane.llm.queries import QUERIES
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"


def plain_words(key, text):
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def smallest_period(words):
    border = [0] * len(words)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def plain_runs(words):
    n, out = len(words), []
    codes = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.empty(0)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], codes[:-q] == codes[q:], [0]]).astype(int)
        edges = np.flatnonzero(np.diff(same))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - begin + q
            if length >= max(6, 4 * q) and smallest_period(words[begin : begin + length]) == q:
                out.append((begin, length, q))
    return sorted(out)


def plain_row(key, text):
    words = plain_words(key, text)
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def found_runs(words):
    """The runs of one list of words, by tiles, strips and joined fragments."""
    memo = {}
    codes = np.array([memo.setdefault(w, len(memo)) for w in words], np.int32)
    n, held = len(words), {}
    for d, octave, first, size in tiles(codes, np.array([n])):
        begin = max(0, first - periods.reach(octave))
        for q, start, stop in strip_fragments(codes[begin:].tolist(), n, octave, first, size):
            held.setdefault(q, []).append((start, stop))
    out = []
    for q, spans in held.items():
        joined = []
        for start, stop in sorted(spans):
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(stop, joined[-1][1])
            else:
                joined.append([start, stop])
        out += [(s, e - s + q, q) for s, e in joined if e - s + q >= max(6, 4 * q)]
    return sorted(out)


def test_z_function():
    r = random.Random(1)
    for _ in range(300):
        x = [r.randint(0, 2) for _ in range(r.randint(1, 40))]
        want = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert z_function(x)[1:] == want[1:]


@pytest.mark.parametrize("strip", [1, 64, 4096])
def test_tiles_find_all_runs(monkeypatch, strip):
    monkeypatch.setattr(periods, "STRIP", strip)
    r = random.Random(strip)
    for _ in range(400):
        words = [r.randint(0, r.choice([1, 2, 5, 100])) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 4)):  # powers, with a piece of a further period, in each other too
            piece = [r.randint(0, r.choice([1, 3, 50])) for _ in range(r.randint(1, 25))]
            if words and r.random() < 0.4:
                piece = words[-r.randint(1, len(words)) :][:60]
            words += piece * r.randint(2, 9) + piece[: r.randint(0, len(piece))]
            words += [r.randint(0, 3) for _ in range(r.randint(0, 9))]
        assert found_runs(words) == plain_runs(words), words


def test_a_long_unary_text_is_few_strips():
    words = np.zeros(100_000, np.int32)
    found = list(tiles(words, np.array([100_000])))
    assert len(found) < 100 and {octave for _, octave, _, _ in found} == {0}


def test_words_are_cut_at_ascii_blanks_only():
    texts = ["", " \t\n", " a\x0bb\x0cc\r\nd ", "x\x1cy z  w", "one"]
    words = Words([None] * 5, texts)
    assert words.counts.tolist() == [len(t.encode().split()) for t in texts]
    assert [words.joined(i) for i in range(5)] == [b" ".join(t.encode().split()) for t in texts]


def test_kept_words():
    assert kept_words(8, [(1, 6, 1)]).tolist() == [True, True, False, False, False, False, False, True]
    assert kept_words(0, []).tolist() == []


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))


def test_runs_of_edge_rows(make_docs, edge_texts, no_docs):
    r = random.Random(7)
    texts = list(edge_texts)
    for key in range(1000, 1060):
        words = prose(key, r.randint(1, 200)).split(" ")
        at, size = r.randrange(len(words)), r.randint(1, 30)
        words[at:at] = words[at : at + size] * r.randint(3, 8)
        texts.append((key, " ".join(words)))
    texts += [(None, "no no no no no no no yes")] * 40
    want = sorted((plain_row(k, t) for k, t in texts if k != 7), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))
    got = [r for r in rows_of(periodic_runs(make_docs(texts).repartition(4))) if r[0] != 7]
    assert got == want
    assert periodic_runs(no_docs).count() == 0


def test_a_very_long_text(make_docs):
    words = prose(9, 40_000).split(" ")
    body = words + words[:700] * 50 + ["end"] + ["ab", "cd"] * 20_000
    row = periodic_runs(make_docs([(3, " ".join(body))])).first()
    assert row.n_runs >= 2 and (row.length, row.period) == (40_000, 2)
    assert row.start == 40_000 + 35_000 + 1


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 15_000}
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()]
    assert len(got) == len(docs)
    assert sorted(r for r in got if r[0] in short) == sorted(plain_row(k, t) for k, t in short.items())
