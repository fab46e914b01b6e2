"""Whole texts to token ids by the tokenizers library."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftline.llm.cluster import FORGET, worker_turns_to

#: Bytes of chunks and their ids that a worker remembers, about, in each of two halves: when the younger is full, the
#: elder is forgotten and the younger takes its place. What is met again moves to the younger half.
CACHE_BYTES = 24 << 20
#: What a remembered chunk takes besides its letters and ids.
EACH = 180
#: Longer chunks are encoded each time.
LONGEST = 64
#: Bytes of texts that are cut into chunks at once; a longer text is cut by itself.
AT_ONCE = 4 << 20

LETTERS = r"A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = r"!-&(-/:-@\[-`{}~"
PIECE = re.compile(rf"[{LETTERS}]+|[0-9]|[{MARKS}]+")
PLAIN = re.compile(rf"(?:[{LETTERS}0-9{MARKS}])+")
#: What is one piece, lower-cased, and spelt letter by letter.
WORD = re.compile(r"[a-zß-öø-ÿ]+")
#: For Arrow: texts that can be lower-cased and cut as a whole, and what is cut off from letters there.
SIMPLE, CUT = rf"^[A-Za-zÀ-ÖØ-öø-ÿ0-9{MARKS}\t\n\f\r ]*$", rf"[0-9]|[{MARKS}]+"


class Encoder:
    """Ids of whole texts as little-endian integers of `width` bytes, by a tokenizers file.

    For a tokenizer that drops white space and never joins over it, a text's ids are those of its chunks
    between white space one after the other: each distinct chunk of a batch is encoded once, and its ids are
    remembered. A chunk of plain Latin letters, digits and marks is cut further, just as such a tokenizer's own
    rule cuts it, and for one that lower-cases, Latin chunks are lower-cased first. Any other tokenizer encodes
    each text as it is.

    cache_bytes and at_once are CACHE_BYTES and AT_ONCE for a task that has room for more.
    """

    def __init__(self, path: str, cache_bytes: int | None = None, at_once: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.by_chunk = self._drops_space()
        self.lowers = self.by_chunk and all(self._ids(t) == self._ids(t.lower()) for t in ("QUITE Öde", "Él"))
        self.spelt = self._spelling() if self.lowers else {}
        if self.spelt and hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words come here once, and keeping them there doubles their time
        self.cache_bytes, self.at_once = cache_bytes, at_once
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.bytes = 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _drops_space(self) -> bool:
        if any(t.lstrip or t.rstrip or not t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        as_one = "Ab12'S, xx'séß!?;don't 9a-b _c"
        parts = [i for w in as_one.split() for i in self._ids(w)]
        return self._ids(as_one.replace(" ", " \n\t ")) == parts and self._ids("Ab12,xé!?") == [i for p in PIECE.findall("Ab12,xé!?") for i in self._ids(p)]

    def _spelling(self) -> dict[int, str]:
        """How the pre-tokenizer spells Latin small letters, if their words can go to the model that way."""
        letters = [chr(i) for i in range(97, 256) if chr(i).isalpha() and chr(i).islower()]
        spelt = {}
        for c in letters:
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
            if len(parts) == 1:
                spelt[ord(c)] = parts[0][0]
        tries = ["a", "thing", "qxzkjw", "é", "été", "größe", "ñandú", *("x" + c + "y" for c in letters)]
        same = all(self._ids(t) == [x.id for x in self.model.tokenize(t.translate(spelt))] for t in tries)
        return spelt if same and len(spelt) == len(letters) else {}

    def _direct(self, text: str) -> bytes:
        return np.array(self._ids(text), f"<u{self.width}").tobytes()

    def _remembered(self, text: str, ids: bytes) -> bytes:
        if self.bytes >= (self.cache_bytes or CACHE_BYTES):
            self.elder, self.known, self.bytes = self.known, {}, 0
        self.known[text] = ids
        self.bytes += len(text) + len(ids) + EACH
        return ids

    def _recalled(self, text: str) -> bytes | None:
        ids = self.known.get(text)
        if ids is None:
            ids = self.elder.get(text)
            if ids is not None:
                self._remembered(text, ids)
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self._recalled(piece)
        if ids is None:
            if self.spelt and self.spelt.keys() >= set(map(ord, piece)):
                ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.spelt))])
            else:
                ids = self._direct(piece)
            self._remembered(piece, ids)
        return ids

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Most that are new are words of small letters: these go straight to the model."""
        found = list(map(self.known.get, chunks))
        tokenize, spelt, width = self.model.tokenize, self.spelt, self.width
        for i, ids in enumerate(found):
            if ids is not None:
                continue
            chunk = chunks[i]
            if not spelt or len(chunk) > LONGEST or not WORD.fullmatch(chunk):
                found[i] = self._chunk(chunk)
                continue
            ids = self.elder.get(chunk)
            if ids is None:
                ids = b"".join([t.id.to_bytes(width, "little") for t in tokenize(chunk if chunk.isascii() else chunk.translate(spelt))])
            found[i] = self._remembered(chunk, ids)
        return found

    def _chunk(self, chunk: str) -> bytes:
        if self.lowers and "<|" not in chunk and _latin(chunk):
            chunk = chunk.lower()
        ids = self._recalled(chunk)
        if ids is not None:
            return ids
        if len(chunk) > LONGEST or not PLAIN.fullmatch(chunk):
            ids = self._direct(chunk)
            return ids if len(chunk) > LONGEST else self._remembered(chunk, ids)
        pieces = PIECE.findall(chunk)
        if len(pieces) == 1:
            return self._piece(chunk)
        return b"".join(map(self._piece, pieces))

    def __call__(self, text: str | None) -> bytes:
        return next(self.many(pa.array([text], pa.string())))

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null one has none."""
        if not self.by_chunk:
            for text in texts.to_pylist():
                yield self._direct(text) if text else b""
            return
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (self.at_once or AT_ONCE), "right")))
            part = pc.fill_null(texts.slice(at, upto - at), "")
            odd = pc.match_substring_regex(part, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)  # white space to Arrow alone
            spaced = part
            if self.lowers:
                simple = pc.match_substring_regex(part, SIMPLE)
                spaced = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(simple, part, "")), CUT, r" \0 ")
                spaced = pc.if_else(simple, spaced, part)
            words = pc.utf8_split_whitespace(spaced)
            flat = words.flatten().dictionary_encode()
            ids = pa.array(self._chunks(flat.dictionary.to_pylist()), pa.large_binary())
            every = ids.take(flat.indices)
            starts = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1, every.offset * 8)
            data = memoryview(every.buffers()[2]) if every.buffers()[2] is not None else b""
            bounds = starts[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist() if len(every) else [0] * (len(part) + 1)
            for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                yield self._direct(part[i].as_py()) if odd[i] else bytes(data[s:e])
            at = upto


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, Encoder] = {}
FORGET.append(_encoders.clear)


def encoder(path: str, cache_bytes: int | None = None, at_once: int | None = None) -> Encoder:
    """This worker's encoder for a file, kept from task to task."""
    worker_turns_to("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    own = _encoders[path]
    own.cache_bytes, own.at_once = cache_bytes, at_once
    return own


def width_of(path: str) -> int:
    """Bytes of an id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
