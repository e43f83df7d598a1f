"""Token files and packing: exact ids against whole-text encoding, and the round trip."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rarelane.llm.binary import open_ids, parts_of, read_tokens, write_tokens
from rarelane.llm.packing import Packer, difference, halved, pack_documents, share_out
from rarelane.llm.tokens import Encoder

VOCABULARIES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, spaces", VOCABULARIES)
def test_pieces_give_the_ids_of_the_whole_text(name, spaces, edge_texts):
    r = random.Random(5)
    letters = "ab .,\n'\té1  A<|>İ"
    texts = [t or "" for _, t in edge_texts] + [
        "".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(1500)
    ]
    encode = whole(name)
    got = Encoder(public_tokenizers.path(name), spaces).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encode(t) for t in texts]


def test_files_hold_all_documents_in_key_order(spark, edge_docs, edge_texts, tmp_path):
    folder = str(tmp_path / "tokens")
    write_tokens(edge_docs, folder, public_tokenizers.path("word_bpe_49k.json"), False, 1)
    encode = whole("word_bpe_49k.json")
    want, start = [], 0
    for key, text in sorted(edge_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(encode(text) + [1], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    parts = [open_ids(folder, p) for p in parts_of(folder)]
    assert sum(len(ids) for ids, _ in parts) == start and parts[0][1][0] == 0
    assert all(ids.dtype == np.uint16 for ids, _ in parts)


def test_an_empty_table_gives_no_files(spark, no_docs, tmp_path):
    folder = str(tmp_path / "none")
    write_tokens(no_docs, folder, public_tokenizers.path("word_bpe_49k.json"), False, 1)
    assert read_tokens(spark, folder).count() == 0 and parts_of(folder) == []


def test_differencing():
    assert difference([], 3) == []
    assert difference([8, 7, 6, 5, 4], 2) == [[1, 3, 4], [0, 2]]
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.randint(1, 64) for _ in range(r.randint(1, 40))]
        windows = r.randint(1, 12)
        found = difference(sizes, windows)
        assert sorted(x for w in found for x in w) == list(range(len(sizes))) and len(found) <= windows
        assert all(sum(sizes[i] for i in w) <= 64 for w in share_out(sizes, 64))
    # three items of 40 cannot share two windows of 64: the count rises
    assert len(share_out([40, 40, 40], 64)) == 3
    assert halved(10) == [5, 2, 1, 1, 1] and halved(0) == []


def test_packer_leaves_little_padding():
    r = random.Random(2)
    packer, rows, tokens = Packer(1024, 0), [], 0
    for i in range(2000):
        n = r.randint(1, 3000)
        tokens += n
        rows += packer.add(i, bytes(4 * n))
    rows += packer.close()
    assert sum(row[2] for row in rows) == tokens
    assert packer.next_id * 1024 < tokens * 1.002


def test_packed_pieces(edge_docs, edge_texts, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack_documents(edge_docs, path, True, 0).collect()
    encode = whole("byte_bpe_50k.json")
    want = sorted((k is not None, k or 0, tuple(encode(t) + [0])) for k, t in edge_texts)
    # rows of one key are told apart by their total length and ids
    by = defaultdict(list)
    for row in rows:
        by[row.doc_id, row.doc_tokens].append(row)
    for (key, size), pieces in by.items():
        same = [ids for none, k, ids in want if (k if none else None) == key and len(ids) == size]
        copies = len(same)
        starts = defaultdict(list)
        for p in pieces:
            starts[p.start].append(p)
            at = np.frombuffer(p.ids, "<u4")
            assert len(at) == p.length
            assert any(tuple(at) == ids[p.start : p.start + p.length] for ids in same)
        assert sum(p.length for p in pieces) == copies * size
    sequences = defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(ids) for *_, ids in want)
    assert pack_documents(no_docs, path, True, 0).count() == 0
