"""Public tokenizers, applied to whole texts with a bounded memory of chunks already encoded.

A text is cut only where the tokenizer itself always cuts, so that the ids of the chunks, put one
after another, are the ids of the text. Each chunk that isn't remembered goes through the
``tokenizers`` library; the rest is a look-up. A text with the string of a special token goes through
the library whole, which makes it that token; with ``plain`` such strings are ordinary text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

# Unicode's White_Space characters, which the tokenizers' \s means. Python's \s has
# four more (U+001C to U+001F).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Letters that no normalizer changes but for case (U+0130 becomes two characters).
LATIN = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u024f"

#: Where each kind of tokenizer cuts in any case: at white space, and between a letter and a full
#: stop or comma. "word": white space is dropped. "byte": GPT-2's own treatment of white space.
CHUNKS = {
    "word": re.compile(f"[{LATIN}]+(?=[{WHITE}.,]|\\Z)|[^{WHITE}]+"),
    "byte": re.compile(f" ?[{LATIN}]+(?=[{WHITE}.,]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
}
KINDS = {"word_bpe_49k.json": "word", "byte_bpe_50k.json": "byte"}

#: Chunks that are remembered in one Python worker, and the longest of them (characters).
REMEMBERED = 1_200_000
LONGEST = 40


def _byte_letters() -> dict[str, str]:
    """Byte-level alphabet, keyed by Latin-1 characters: printable bytes stand for themselves, the
    others for U+0100 onwards in ascending order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


PLAIN = re.compile(f" ?[{LATIN}]+")


class _Memory(dict):
    def __init__(self, tokenizer: Tokenizer, width: str, lower: bool):
        super().__init__()
        self.tokenizer, self.model, self.lower, self.letters = tokenizer, tokenizer.model, lower, _byte_letters()
        every = np.arange(tokenizer.get_vocab_size(), dtype=width)
        self.ids = [x.tobytes() for x in every]

    def __missing__(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):  # one word for the model: it needs no more cutting
            if self.lower and (low := chunk.lower()) != chunk:
                got = self[low]
            else:
                got = b"".join([self.ids[t.id] for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))])
        else:
            got = b"".join([self.ids[i] for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids])
        if len(self) < REMEMBERED and len(chunk) <= LONGEST:
            self[chunk] = got
        return got


class TextEncoder:
    """Ids of texts as little-endian bytes, ``width`` bytes ('<u2' or '<u4') an id."""

    def __init__(self, name: str, width: str = "<u4", plain: bool = False):
        self.pattern = CHUNKS[KINDS[name]]
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.size = tokenizer.get_vocab_size()
        self.memory = _Memory(tokenizer, width, KINDS[name] == "word")

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # their neighbours are cut otherwise
            return b"".join([self.memory.ids[i] for i in self.memory.tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.memory.__getitem__, self.pattern.findall(text)))


class _Pieces(dict):
    def __init__(self, model: sentencepiece.SentencePieceProcessor, raw: list[bytes]):
        super().__init__()
        self.model, self.raw = model, raw

    def __missing__(self, chunk: str) -> bytes:
        ids = self.model.encode(chunk)
        same = b"".join([self.raw[i] for i in ids]) == chunk.encode("utf-8", "surrogatepass")
        got = np.array(ids, "<u2").tobytes() if same else None
        if len(self) < REMEMBERED // 2 and len(chunk) <= LONGEST:
            self[chunk] = got
        return got


class PieceEncoder:
    """Ids (``<u2``) of a sentencepiece BPE model with byte fallback, for texts with the leading space
    that the model adds; None if the bytes of the pieces, joined, aren't those of the text.

    Pieces have white space in front only, or are white space, and none has a letter of LATIN before
    a full stop, comma or line feed, or a line feed beside anything; a text is cut there. A vocabulary that
    breaks this is applied to whole texts.
    """

    CHUNKS = re.compile(f" *[{LATIN}]+(?=[ \\n.,]|\\Z)|\\n| *[^ \\n]+| +")
    CROSSING = re.compile(f"[^ ] |\\n.|.\\n|[{LATIN}][.,]", re.S)

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec.normalizer_spec.add_dummy_prefix = False
        model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        normal = spec.pieces[0].NORMAL
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace("\u2581", " ").encode() for p in spec.pieces]
        self.lengths = np.array([len(x) for x in self.raw], np.int64)
        if any(p.type == normal and self.CROSSING.search(p.piece.replace("\u2581", " ")) for p in spec.pieces):
            self.CHUNKS = re.compile("(?s).+")
        self.memory = _Pieces(model, self.raw)

    def __call__(self, text: str) -> bytes | None:
        if "\u2581" in text:
            return None
        got = list(map(self.memory.__getitem__, self.CHUNKS.findall(text)))
        return None if None in got else b"".join(got)


@lru_cache(2)
def encoder(name: str, width: str = "<u4", plain: bool = False) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(name, width, plain)


@lru_cache(1)
def piece_encoder(name: str) -> PieceEncoder:
    return PieceEncoder(name)


@lru_cache(2)
def byte_lengths(name: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for: a letter of an entry is a byte."""
    vocab = Tokenizer.from_file(public_tokenizers.path(name)).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for entry, i in vocab.items():
        out[i] = len(entry)
    return out


@lru_cache(8)
def vocabulary_size(name: str) -> int:
    return Tokenizer.from_file(public_tokenizers.path(name)).get_vocab_size()
