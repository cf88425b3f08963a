"""Token ids of whole texts by a public tokenizer file, fast on repeated words.

A text is cut at every line end, and before every single space between two non-space characters. The
tokenizers' own pre-tokenizers never join text over such a place, so the ids of the chunks, joined, are
the ids of the text; each distinct chunk is encoded by the tokenizers library once and remembered. Signs
after the letters of a chunk are pre-tokens of their own, so a word is encoded once whatever follows it;
whether a character outside ASCII is a letter to the tokenizer, also once normalised, is asked of its own
normalizer and pre-tokenizer.
Chunks are found and looked up by 64-bit hashes with numpy, not one by one.
A text with any other use of white space, or with the string of a special token where those are told
from text, is encoded by the library as a whole.
"""

from __future__ import annotations

import os
import string
from array import array

import numpy as np
import pyarrow as pa

from loquat.llm.text import Places, alphabet, ascii_lower, chunks_of, decode, encode, mix

_CHUNKS = alphabet(b" \n")
_FIRST = np.uint64(2)
_UNKNOWN, _BAD = -2, -1
#: No letters, numbers or white space.
_SIGNS = string.punctuation


class _Known(dict):
    """Ids by chunk; it starts anew at about ``limit`` chunks."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def missing(self, chunks: set[str]) -> set[str]:
        if len(self) > self.limit:
            self.clear()
        return chunks.difference(self)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. ``limit``: chunks remembered, about.

    ``specials``: the string of a special token in a text becomes its id, as the library does unless told
    otherwise; without, it is ordinary text."""

    def __init__(self, path: str, end_id: int | None = 1, limit: int = 1_000_000, specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Strings that make a text one for the library; an empty one is in every text.
        self.whole = [b"" if x.normalized else ascii_lower(encode(x.content)) for x in added if specials or not x.special]
        self.letters, self.others = set(), set()
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.heads, self.tails, self._table = _Known(limit // 16), _Known(limit // 16), _Table(limit)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        tokens = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        #: By id: whether it ends a word of the model, or else its bytes.
        self.ends = np.array([t.endswith(suffix) for t, _ in tokens]) if suffix else None
        byte_level = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.sizes = np.array([len(t) for t, _ in tokens]) if not suffix and byte_level else None
        #: Letters, then a sign, are two pre-tokens; a word's ids do not depend on a sign after it.
        self.apart = suffix is not None or byte_level
        self.lowers = self._library(["Az"]) == self._library(["az"])
        self.signs = {"": b""}
        self.line_end = self._library(["\n"])[0]

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _several(self, texts: list[str]) -> list[bytes]:
        """Ids of each chunk (a space and letters, or letters): encoded as one text if its ids can be told apart again."""
        out = []
        for i in range(0, len(texts), 1000):
            group = texts[i : i + 1000]
            between = "" if group[0].startswith(" ") else "\n"
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(group)], add_special_tokens=False)[0].ids, "<u4")
            if self.sizes is not None:
                reach, gap = np.cumsum(self.sizes[ids]), len(between)
                last = np.cumsum([len(x.encode()) + gap for x in group]) - gap
                first = np.r_[0, last[:-1] + gap]
            else:
                reach = np.cumsum(self.ends[ids])
                last, first = np.arange(1, len(group) + 1), np.arange(len(group))
            reach = np.r_[0, reach]
            stop, start = np.searchsorted(reach, last), np.searchsorted(reach, first)
            if reach[-1] != last[-1] or stop[-1] != len(ids) or not (np.array_equal(reach[stop], last) and np.array_equal(reach[start], first)):
                out += self._library(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((4 * start).tolist(), (4 * stop).tolist(), strict=True)]
        return out

    def _all_letters(self, stem: str) -> bool:
        """Whether a stem of letters stays one, and apart from a sign after it, when normalised."""
        if stem.isascii():
            return True
        chars = set(stem)
        for c in chars - self.letters - self.others:
            text = f"a{c}b!"
            if self.tokenizer.normalizer is not None:
                text = self.tokenizer.normalizer.normalize_str(text)
            (self.letters if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 2 else self.others).add(c)
        return not chars & self.others

    def _learn(self, known: _Known, chunks: set[str], prefix: str) -> None:
        new = known.missing(chunks)
        bases, composed, other, signs = set(), [], [], self.signs
        lowers, apart = self.lowers, self.apart
        for x in new:
            stem = x.rstrip(_SIGNS)
            if apart and stem.isalpha() and self._all_letters(stem):
                sign = x[len(stem) :]
                if sign not in signs:
                    if len(signs) > 10_000:
                        signs.clear()
                        signs[""] = b""
                    signs[sign] = self._library([sign])[0]
                if lowers and stem.isascii():
                    stem = stem.lower()
                bases.add(stem)
                if stem != x:
                    composed.append((x, stem, signs[sign]))
            elif not x or x[0].isspace() or x[-1].isspace():
                known[x] = None
            else:
                other.append(x)
        plain = list(bases.difference(known))
        known.update(zip(plain, self._several([prefix + x for x in plain]), strict=True))
        known.update([(x, known[stem] + sign) for x, stem, sign in composed])
        known.update(zip(other, self._library([prefix + x for x in other]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, then the end id; null is empty."""
        raws = [encode(x) for x in texts]
        out: list[bytes] = []
        for group in chunks_of(raws):
            out += self._encode_group(group)
        return out

    def _encode_group(self, raws: list[bytes]) -> list[bytes]:
        blob = b"\n" + b"\n".join(raws) + b"\n"
        if self.lowers:
            blob = ascii_lower(blob)
        places = Places(blob, [len(x) for x in raws], _CHUNKS)
        kind = (np.frombuffer(blob, np.uint8)[places.before] == 10).astype(np.uint64)
        full = places.counts > 0
        kind[places.first[full]] = _FIRST
        every, index, number = np.unique(mix(places.hashes + kind), return_index=True, return_inverse=True)
        start, length = self._table.find(every)
        new = np.flatnonzero(length == _UNKNOWN)
        if len(new):
            at = index[new]
            ids = self._chunk_ids([decode(blob[b + 1 : e + 1]) for b, e in zip(places.before[at].tolist(), places.last[at].tolist(), strict=True)], kind[at].tolist())
            self._table.add(every[new], ids, keep=every)
            start, length = self._table.find(every)
        taken = length[number]
        # Texts with other white space: a chunk that is none, or fewer chunks than places to cut.
        text = np.repeat(np.arange(len(raws)), places.counts)
        odd = np.bincount(text, weights=taken == _BAD, minlength=len(raws)) > 0
        odd |= places.counts != np.array([x.count(b" ") + x.count(b"\n") + 1 for x in raws])
        for string in self.whole:
            if string in (blob if self.lowers else ascii_lower(blob)):
                odd |= [string in ascii_lower(x) for x in raws]
        taken = np.maximum(taken, 0)
        reach = np.cumsum(taken)
        ids = self._table.flat[np.repeat(start[number] - (reach - taken), taken) + np.arange(reach[-1] if len(reach) else 0)]
        ends = np.r_[0, reach][places.first + places.counts].tolist()
        begins = np.r_[0, reach][places.first].tolist()
        slow = {k: self._library([decode(raws[k])])[0] if raws[k] else b"" for k in np.flatnonzero(odd).tolist()}
        return [(slow[k] if k in slow else ids[b:e].tobytes()) + self.end for k, (b, e) in enumerate(zip(begins, ends, strict=True))]

    def _chunk_ids(self, chunks: list[str], kinds: list[int]) -> list[bytes | None]:
        """Ids of chunks that begin a text, a line, or follow a space; null for what is no chunk."""
        begun = {x for x, k in zip(chunks, kinds, strict=True) if k}
        self._learn(self.heads, begun, "")
        self._learn(self.tails, {x for x, k in zip(chunks, kinds, strict=True) if not k}, " ")
        line_end, heads, tails, out = self.line_end, self.heads, self.tails, []
        for x, k in zip(chunks, kinds, strict=True):
            ids = heads[x] if k else tails[x]
            out.append(line_end + ids if k == 1 and ids is not None else ids)
        return out


class _Table:
    """Ids by chunk hash: sorted hashes, and where each one's ids lie in one flat array."""

    def __init__(self, limit: int):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.full(len(keys), _UNKNOWN)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.start[at], np.where(self.keys[at] == keys, self.length[at], _UNKNOWN)

    def add(self, keys: np.ndarray, ids: list[bytes | None], keep: np.ndarray) -> None:
        """Learn new keys, sorted, and their ids. Beyond the limit all but the keys in ``keep`` are forgotten."""
        length = np.array([_BAD if x is None else len(x) // 4 for x in ids], np.int64)
        if len(self.keys) + len(keys) > self.limit:
            start, held = self.find(keep)
            known = held != _UNKNOWN
            kept = [None if n == _BAD else self.flat[a : a + n].tobytes() for a, n in zip(start[known].tolist(), held[known].tolist(), strict=True)]
            self._clear()
            if known.any() and len(kept) <= self.limit:
                self.add(keep[known], kept, keep[:0])
        raw = np.frombuffer(b"".join(x for x in ids if x), "<u4")
        if self.used + len(raw) > len(self.flat):
            grown = np.empty(2 * (self.used + len(raw)), "<u4")
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(raw)] = raw
        start = self.used + np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        self.used += len(raw)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.length = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.length, at, length)


class PieceEncoder(Encoder):
    """Texts to ids of a sentencepiece model that puts a space before a text and joins no piece across a space or a line end.

    Whether a model does so is asked of its vocabulary, and whether it leaves characters alone of some that others change;
    one that does not takes texts as wholes."""

    def __init__(self, path: str, limit: int = 1_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole, self.end, self.lowers = [], b"", False
        self.heads, self.tails, self._table = _Known(limit // 16), _Known(limit // 16), _Table(limit)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.apart = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        probe = "x\nﬁＡe\u0301 \u3000é"
        self.apart &= self.model.decode(self.model.encode(probe)) == probe
        begin = self._library(["\n"])[0]
        #: Ids of the space that the model puts before a text, and of a line end.
        self.space, self.line_end = begin[:4], begin[4:]
        self.apart &= len(begin) == 8

    def vocabulary(self) -> int:
        return self.model.get_piece_size()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.model.encode(texts, out_type=int, num_threads=1)]

    def _encode_group(self, raws: list[bytes]) -> list[bytes]:
        return super()._encode_group(raws) if self.apart else self._library([decode(x) for x in raws])

    def _chunk_ids(self, chunks: list[str], kinds: list[int]) -> list[bytes | None]:
        """A chunk that begins a text follows a space too; one that begins a line is encoded behind a line end."""
        heads, tails = self.heads, self.tails
        begun = list(heads.missing({x for x, k in zip(chunks, kinds, strict=True) if k == 1}))
        heads.update(zip(begun, (x[len(self.space) :] for x in self._library(["\n" + x for x in begun])), strict=True))
        rest = list(tails.missing({x for x, k in zip(chunks, kinds, strict=True) if k != 1}))
        tails.update(zip(rest, self._library(rest), strict=True))
        return [heads[x] if k == 1 else tails[x] for x, k in zip(chunks, kinds, strict=True)]


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(path: str, end_id: int | None, specials: bool = False) -> Encoder:
    """One a Python worker, so that later tasks find what earlier ones learned."""
    key = path, end_id, specials
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, end_id, specials=specials)
    return _encoders[key]


def encoded(batch: pa.RecordBatch, text: str, encoder: Encoder, step: int = 1000):
    """(row number, ids) of every row of a batch, a few rows at a time."""
    for i in range(0, batch.num_rows, step):
        yield from enumerate(encoder.encode(batch.slice(i, step).column(text).to_pylist()), i)
