"""Token ids by the tokenizers library, faster by merging each distinct piece of a batch once.

A byte-level BPE splits a text into pre-tokens by a fixed pattern and encodes each
by itself, so equal ones need encoding once. A single blank before another character
always begins a pre-token, so a text may be cut at its blanks first and each distinct
word, with its blank, split once, unless a blank is followed by another or ends the text,
where the pattern looks further. Words and pre-tokens are numbered by Arrow, the library
merges many distinct pre-tokens in one call, parted by a sign that nothing merges with,
and the texts' ids are gathered by number. Texts whose characters might be classed
differently by another Unicode version, and texts that hold an added token such as
``<|endoftext|>``, which gets its own id, go to the library whole.

Nothing is kept from batch to batch: memory follows from ``STEP``, and a long text is
encoded in segments.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Characters encoded together, characters of a segment of a long text, and pieces merged in one call.
STEP, SEGMENT, CALL = 16_000_000, 4_000_000, 20_000
#: What parts the pieces that are handed to the library's merges at once.
PIECE_END = "\x00"
#: Characters on which Python's classes and the library's agree: old blocks of Latin, Greek, Cyrillic,
#: punctuation and the euro sign, without U+001C to U+001F, which only Python takes for blanks, and PIECE_END.
SETTLED = re.compile("[\x01-\x1b\x20-ʯΑ-ΡΣ-ҁ‐-‧‰-⁞€]*+")
# Fixed value: how this kind of byte-level BPE splits a text (contractions, letters, numbers, the rest, blanks),
# for settled characters; the six signs are numbers that Python counts among its word characters.
SPLIT = re.compile(
    r" ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)

#: A blank with another one, or nothing, after it.
UNEVEN = re.compile(r" (?:\s|\Z)")
#: Places where one pre-token surely ends and another begins, whatever stands around them.
SURE = re.compile(r"(?<=[A-Za-z])(?=[!-@])|(?<=[!-~])(?=[ \t\n\r])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gather(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[bounds[c]:bounds[c + 1]]`` of all codes one after the other, and their bounds."""
    n = np.diff(bounds)[codes]
    new = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(new[-1]) + np.repeat(bounds[codes] - new[:-1], n)], new


def _joined(strings: pa.Array, sign: str) -> str:
    one = pa.ListArray.from_arrays([0, len(strings)], strings)
    return pc.binary_join(one, pa.scalar(sign, strings.type))[0].as_py()


class Encoder:
    """Encodes whole texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        # Bytes stand for themselves where they print, else for characters from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = sorted(set(range(256)).difference(plain))
        self.chars = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}
        # The sign that parts pieces stands in no longer token, so nothing merges with it.
        sign = chr(self.chars[ord(PIECE_END)])
        self.end = self.library.token_to_id(sign)
        self.parted = self.end is not None and not any(sign in t for t in self.library.get_vocab() if len(t) > 1)

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and their bounds."""
        parts, tokenize = [], self.library.model.tokenize
        for k in range(0, len(pieces), CALL):
            joined = _joined(pieces.slice(k, CALL), PIECE_END) + PIECE_END
            mapped = joined.encode("utf-8").decode("latin-1").translate(self.chars)
            parts.append(np.array([t.id for t in tokenize(mapped)], "<u4"))
        ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
        ends = np.flatnonzero(ids == self.end)
        return ids[ids != self.end], np.concatenate([[0], ends - np.arange(len(ends))])

    def _step(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, of which there are no more than memory allows."""
        out: list = [np.empty(0, "<u4")] * len(texts)
        at, heads, n_heads, rests = [], [], [0], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.parted or not SETTLED.fullmatch(text) or any(map(text.__contains__, self.added)):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
                continue
            head, _, rest = (text, "", "") if UNEVEN.search(text) else text.partition(" ")
            at.append(k)
            heads += SPLIT.findall(head)
            n_heads.append(len(heads))
            rests.append(rest or None)
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        # Only a word's own blank begins a piece with one, so the pieces can be told apart by word.
        pieces = SPLIT.findall(" " + _joined(words.dictionary, " ")) if len(words) else []
        n, pieces = len(pieces), pa.array(pieces + heads, pa.large_string()).dictionary_encode()
        codes, begins = pieces.indices.to_numpy(), pc.starts_with(pieces.dictionary, " ").to_numpy(zero_copy_only=False)
        ids, bounds = _gather(*self._merged(pieces.dictionary), codes)
        of_words = bounds[[*np.flatnonzero(begins[codes[:n]]), n]]
        word_ids, word_bounds = _gather(ids, of_words, words.indices.to_numpy())
        last = word_bounds[lists.offsets.to_numpy()].tolist()
        first = bounds[n + np.array(n_heads)].tolist()
        for j, k in enumerate(at):
            out[k] = np.concatenate([ids[first[j] : first[j + 1]], word_ids[last[j] : last[j + 1]]])
        return out

    def _segments(self, text: str) -> list[str]:
        """The text, or parts of it that can be encoded by themselves."""
        if len(text) <= SEGMENT or any(map(text.__contains__, self.added)):
            return [text]
        cuts = [0]
        while cuts[-1] + SEGMENT < len(text) and (m := SURE.search(text, cuts[-1] + SEGMENT)):
            cuts.append(m.start())
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def encode_all(self, texts: Iterable[str | None], at_once: int = STEP) -> Iterator[np.ndarray]:
        """The ids of each text in turn; none for a null or empty one. ``at_once`` characters are encoded together."""
        some, last, size, parts = [], [], 0, []

        def step() -> Iterator[np.ndarray]:
            for ids, ends in zip(self._step(some), last, strict=True):
                parts.append(ids)
                if ends:
                    yield np.concatenate(parts) if len(parts) > 1 else ids
                    parts.clear()
            some.clear()
            last.clear()

        for text in texts:
            segments = self._segments(text or "")
            for k, segment in enumerate(segments, 1):
                some.append(segment)
                last.append(k == len(segments))
                size += len(segment)
                if size >= at_once:
                    yield from step()
                    size = 0
        yield from step()

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` alone."""
        return next(self.encode_all([text])).tobytes()

    def documents(self, texts: Iterable[str | None], at_once: int = STEP) -> Iterator[np.ndarray]:
        """The ids of each document: its text's, then the end id."""
        end = np.array([END_ID], "<u4")
        for ids in self.encode_all(texts, at_once):
            yield np.concatenate([ids, end])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
