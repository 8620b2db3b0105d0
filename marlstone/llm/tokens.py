"""Token ids of whole texts, by the tokenizers library and bounded tables of words and pieces already seen."""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from marlstone.llm.common import LONGEST, kept, ranges, split_words

#: Id that ends every document.
END_ID = 1
#: Fixed value: the splitting pattern of the vocabularies whose words are cut into pieces here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of other characters may change their NFC form, or not lower-case letter by letter.
_OTHER = re.compile(r"[^\n!-~À-ÖØ-öø-ÿ]")
#: PATTERN on lower-cased words of those characters, each in a line of its own.
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")


class _Codes(dict):
    """Key -> code; an unknown key gets the next code."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class _Ids:
    """Ids of keys by code. Keys beyond the first `known`, and long ones, are forgotten with the next call."""

    def __init__(self, known: int):
        self.known = known
        self.codes = _Codes()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.kept, self.used = 0, 0

    def look_up(self, keys: list, tell) -> np.ndarray:
        """Codes of keys; tell(new keys) gives the ids of those that are new, one after the other, and how many each has."""
        for key in self.codes.new:
            del self.codes[key]
        self.codes.new = []
        codes = np.fromiter(map(self.codes.__getitem__, keys), np.int64, len(keys))
        new = self.codes.new
        if new:
            flat, lengths = tell(new)
            while len(self.flat) < self.used + len(flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.starts) < self.kept + len(new):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            self.flat[self.used : self.used + len(flat)] = flat
            self.lengths[self.kept : self.kept + len(new)] = lengths
            self.starts[self.kept : self.kept + len(new)] = self.used + np.cumsum(lengths) - lengths
            # The first of the new ones stay, up to the bound and to the first long one.
            stay = 0
            while stay < len(new) and self.kept + stay < self.known and len(new[stay]) <= LONGEST:
                stay += 1
            self.codes.new = new[stay:]
            self.used += int(np.sum(lengths[:stay]))
            self.kept += stay
        return codes

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes of the last call, one after the other, and how many each has."""
        lengths = self.lengths[codes]
        return self.flat[ranges(self.starts[codes], lengths)], lengths


class WordTokenizer:
    """Encodes texts white-space piece by white-space piece.

    The vocabulary's normaliser, its splitting pattern and its added tokens never look across ASCII white space, so
    the ids of a text are those of its words in order. Words of plain characters are lower-cased and cut by the same
    pattern here, if it is the vocabulary's, so that the library encodes each distinct piece once; all others it gets
    whole (the tests compare both with the library's own ids). Tables of words and pieces are bounded in bytes.
    """

    def __init__(self, path: str, known: int = 200_000, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.words, self.pieces = _Ids(known), _Ids(2 * known)
        with open(path, encoding="utf-8") as file:
            rule = json.load(file)
        steps = [x.get("type") for x in ((rule.get("normalizer") or {}).get("normalizers") or [])]
        split = ((rule.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.cuts = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == PATTERN and split.get("behavior") == "Removed"
        # Words that hold an added token are for the library alone.
        self.added = [t["content"] for t in rule.get("added_tokens") or []]
        suffix = rule.get("model", {}).get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.cuts = self.cuts and bool(suffix)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.cuts:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            # The same model, for pieces that are normal and cut already.
            self.cut_tokenizer = Tokenizer.from_file(path)
            self.cut_tokenizer.normalizer = normalizers.Sequence([])
            self.cut_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces.look_up(["\n"], self._pieces)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces by the library, many in one call; the end of a line has none. The last id of a piece
        stands for the end of a word, which tells them apart."""
        real = np.array([p != "\n" for p in pieces], bool)
        some = [p for p in pieces if p != "\n"]
        found = [self.cut_tokenizer.encode(" ".join(some[a : a + 128]), add_special_tokens=False).ids for a in range(0, len(some), 128)]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(self.last[flat]) + 1
        lengths = np.zeros(len(pieces), np.int64)
        lengths[real] = np.diff(ends, prepend=0)
        return flat, lengths

    def _plain(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters, each with the end of its line."""
        codes = self.pieces.look_up(_PIECES.findall(lines.lower()), self._pieces)
        flat, sizes = self.pieces.ids(codes)
        ends = np.cumsum(sizes)[codes == self.pieces.codes["\n"]]
        return flat, np.diff(np.concatenate([[0], ends]))

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that were not met before."""
        lines = b"\n".join(words).decode()
        if self.cuts and not _OTHER.search(lines) and not any(x in lines for x in self.added):
            return self._plain(lines + "\n")
        texts = lines.split("\n")
        plain = np.array([self.cuts and not _OTHER.search(t) and not any(x in t for x in self.added) for t in texts], bool)
        flat, sizes = self._plain("".join(t + "\n" for t, p in zip(texts, plain.tolist()) if p))
        other, other_sizes = self._encode([t for t, p in zip(texts, plain.tolist()) if not p])
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[plain], lengths[~plain] = sizes, other_sizes
        starts[plain], starts[~plain] = np.cumsum(sizes) - sizes, len(flat) + np.cumsum(other_sizes) - other_sizes
        return np.concatenate([flat, other])[ranges(starts, lengths)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the len(texts) + 1 edges between them. Null counts as empty."""
        codes, edges, words = split_words(texts)
        flat, lengths = self.words.ids(self.words.look_up(words, self._new)[codes])
        ends = np.concatenate([[0], np.cumsum(lengths)])[edges[1:]]
        sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        if self.end_id is not None:
            flat = np.insert(flat, ends, self.end_id)
            sizes = sizes + 1
        return flat.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def coder(path: str, end_id: int | None = END_ID) -> WordTokenizer:
    """This process's tokenizer for path; Python workers keep it, with the words it knows, from task to task."""
    return kept("tokens", (path, end_id), lambda: WordTokenizer(path, end_id=end_id))
