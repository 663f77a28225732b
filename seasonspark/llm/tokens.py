"""Token ids of whole texts, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

#: Words remembered by one worker, and bytes of text split at once.
KNOWN_WORDS, SPLIT_BYTES = 400_000, 4_000_000

#: A stop or comma that stands alone between a letter and white space: a token run of its own.
APART = r"([a-z])([.,][ \n])"
#: Letters and then ASCII punctuation: two token runs.
TAILED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


def in_slices(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SPLIT_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class WordEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does, word by word.

    Exact for a tokenizer that splits at every white space and keeps none of it, lower-cases,
    and splits letters from punctuation: then the ids of a text are those of its runs without
    ASCII white space, one after the other, whatever stands beside them. A text that may hold a
    special token's string is encoded as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for a-z alone, on which normalizer and byte alphabet do nothing
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}

    def _joined(self, tokenizer: Tokenizer, words: list[bytes]) -> Iterator[bytes]:
        """Ids of letter words, many at a time: each is one run that ends with a token of a word's end."""
        parts = [words[i : i + 512] for i in range(0, len(words), 512)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist() if len(ids) else []
            if len(ends) == len(part):
                data = ids.tobytes()
                yield from [data[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
            else:
                yield from self._singly(part)

    def _singly(self, words: list[bytes]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, plain, joined = self.known, {w for w in words if w.isalpha()}, []
        letters, others = set(), set()
        for w in words - plain:
            text = w.decode()
            if text.lower().isalpha():
                letters.add(w)
            elif (m := TAILED.fullmatch(text)) and m[1].lower().isalpha():
                stem, tail = m[1].encode(), m[2].encode()
                joined.append((w, stem, tail))
                others.add(tail)
                (plain if m[1].isascii() else letters).add(stem)
            else:
                others.add(w)
        for names, encoded in ((plain, lambda x: self._joined(self.bare, x)), (letters, lambda x: self._joined(self.tokenizer, x)), (others, self._singly)):
            names = [x for x in names if x not in known]
            known.update(zip(names, encoded(names), strict=True))
        known.update((w, known[stem] + known[tail]) for w, stem, tail in joined)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers.

        Words are split and numbered by Arrow; Python sees each distinct word of the slice once.
        """
        special = [i for i, t in enumerate(texts) if b"<|" in t]
        plain = list(texts)
        for i in special:
            plain[i] = b""
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(pa.array(plain, pa.string())), APART, r"\1 \2"))
        numbered = words.flatten().dictionary_encode()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.known[b""] = b""
        distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
        self._learn(set(distinct).difference(self.known))
        ids = list(map(self.known.__getitem__, distinct))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), np.frombuffer(b"".join(ids), "<u4"))
        taken = lists.take(numbered.indices)
        data = taken.flatten().to_numpy().astype("<u4", copy=False).tobytes()
        first = taken.offsets.to_numpy() - (taken.offsets[0].as_py() if len(taken.offsets) else 0)
        at = (4 * first[words.offsets.to_numpy() - words.offsets[0].as_py()]).tolist()
        out = [data[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
        del words, numbered, lists, taken, data
        for i in special:
            out[i] = next(self._singly([texts[i]]))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its memory serves all tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
