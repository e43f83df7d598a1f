"""Token ids of whole texts, by the ``tokenizers`` library, with a memo of words.

Texts are cut at single spaces, where both vocabularies always end a token, a batch at a
time, and each distinct piece is encoded once; the ids of a batch are then gathered from
those of its distinct pieces, so no word of a text is a Python object.  With word ends, so is each part (word, marks) of
the pieces that hold nothing else.  Words a task has not met yet are encoded side by side in one
call, and the ids are cut where the vocabulary itself begins or ends a word.  The ids are those of encoding the whole text.
The marks' strings in a text are ordinary text, never the marks themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and parts, that a task remembers; frequent ones come early, so later ones are encoded and forgotten.
MEMO = 500_000
#: Words encoded in one call.
JOINED = 256

#: A space behind one of these belongs to a run of white space.
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = f"[{_BLANKS}] |\\x00"
#: Parts that are always told apart, of pieces that hold nothing else.
_PARTS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+|[.,;:!?]+")
#: Byte-level: one space, then no other and no blank at either end.  Else: letters only.
_WORD = {
    True: re.compile(r" [^\s](?:[^ ]*[^\s])?"),
    False: re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"),
}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``spaces``: whether a space belongs to the token behind it (byte-level
    vocabularies) or is dropped (vocabularies with word ends).
    """

    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer

        self.spaces = spaces
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.vocabulary = self.whole.get_vocab_size()
        # ids that begin a word (byte-level: a space, as its stand-in) or end one
        self.edge = np.zeros(self.vocabulary, bool)
        for token, at in self.whole.get_vocab().items():
            self.edge[at] = token.startswith("\u0120") if spaces else token.endswith("</w>")
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = pa.array(texts, pa.large_string())
        if not self.spaces:  # neither line ends nor the case of A-Z reach the ids
            return self._split(pc.replace_substring(pc.ascii_lower(whole), "\n", " "))
        odd = pc.match_substring_regex(whole, _RUN).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i, data in zip(np.flatnonzero(~odd).tolist(), self._split(whole.filter(pa.array(~odd)))):
            out[i] = data
        for i in np.flatnonzero(odd).tolist():  # a run of blanks stays in one piece
            pieces = re.split(r"(?<=\S)(?= )", texts[i])
            out[i] = b"".join(self._known(pieces))
        return out

    def _split(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts cut at single spaces: those of the distinct words, put in place by arithmetic."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        one = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary)
        # no piece holds a space, so one string of all is the cheapest way to Python
        pieces = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if self.spaces:  # a space belongs to the word behind it, so the first word of a text has none
            first, own = np.unique(codes[offsets[:-1]], return_inverse=True)
            bare = [pieces[c] for c in first.tolist()]
            codes[offsets[:-1]] = len(pieces) + own
            pieces = [" " + w for w in pieces] + bare
        data = self._known(pieces)
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        begins = np.cumsum(sizes) - sizes
        count = sizes[codes]
        ends = np.cumsum(count)
        place = np.arange(ends[-1]) + np.repeat(begins[codes] - (ends - count), count)
        ids = np.frombuffer(b"".join(data), "<u4")[place].tobytes()
        stops = [0, *(4 * ends[offsets[1:] - 1]).tolist()]
        return [ids[s:e] for s, e in zip(stops[:-1], stops[1:])]

    def _known(self, pieces: list[str]) -> list[bytes]:
        known = self.pieces
        missing = {p for p in pieces if p not in known}
        known.update(self._encode_words(missing) if self.spaces else self._encode_pieces(missing))
        out = list(map(known.__getitem__, pieces))
        _forget(known, missing)
        return out

    def _encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        split, plain = {}, set()
        for piece in pieces:
            parts = _PARTS.findall(piece)
            if sum(map(len, parts)) != len(piece):
                parts = [piece]
            split[piece] = parts
            plain.update(parts)
        known = self.parts
        missing = plain - known.keys()
        known.update(self._encode_words(missing))
        out = {piece: b"".join([known[p] for p in parts]) for piece, parts in split.items()}
        _forget(known, missing)
        return out

    def _encode_words(self, words: set[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words; those that the vocabulary itself tells apart are encoded side by side."""
        plain = _WORD[self.spaces].fullmatch
        apart = [w for w in words if plain(w)]
        for w in words.difference(apart):
            yield w, np.asarray(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        glue, encode = "" if self.spaces else " ", self.whole.encode_batch_fast
        for at in range(0, len(apart), JOINED):
            some = apart[at : at + JOINED]
            ids = np.asarray(encode([glue.join(some)], add_special_tokens=False)[0].ids, "<u4")
            marked = 4 * np.flatnonzero(self.edge[ids])
            edges = [*marked.tolist(), 4 * len(ids)] if self.spaces else [0, *(marked + 4).tolist()]
            data = ids.tobytes()
            for w, begin, end in zip(some, edges[:-1], edges[1:], strict=True):
                yield w, data[begin:end]


def _forget(known: dict[str, bytes], latest: set[str]) -> None:
    """Drops of the latest entries what is beyond the memo's size."""
    for piece in list(latest)[: max(0, len(known) - MEMO)]:
        del known[piece]


@lru_cache(maxsize=2)
def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path, spaces)
