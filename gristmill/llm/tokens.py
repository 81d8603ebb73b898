"""Encoding with the tokenizers library, word by word.

A corpus repeats its words, so each distinct word of a block is encoded once
and kept for later blocks.  This gives the library's own ids only where a text
can be cut without changing them, which depends on the tokenizer:

``lead``
    Byte-level tokenizers without a normalizer whose pattern lets one space
    lead a word: a text may be cut before a space that follows anything but
    white space.
``drop``
    Tokenizers that normalize white space and drop it: a text may be cut at
    any space or line break.

Texts for which the rule does not hold, and all texts of other tokenizers, are
encoded whole.  So are texts that hold one of the tokenizer's added tokens,
such as an end-of-text mark, which the library looks for in texts by default,
and texts in which a combining mark follows a capital, as the library composes
letters before it makes them small.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ._shared import give_back

#: Bytes of text that are encoded at once.
BLOCK_BYTES = 8 << 20
#: Distinct words kept; beyond it a worker goes on with those that came again, or starts anew.
KEPT_WORDS = 1_000_000
#: Tokens put together at once.
_GATHER = 1 << 19
_JOINED = 256
#: Stands before the first word of a text, which no space leads.
_MARK = "\x01"
#: White space, as the widest of the patterns has it; and that or the mark before a space, or the mark.
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WIDE = rf"[\x01{_SPACE}] |\x01"

#: What a "drop" tokenizer does to a text before it looks words up.
_DROP_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_DROP_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Words:
    """Words and their ids, in flat arrays; ``again`` are those that came in a later block."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)
        self.again = np.zeros(0, bool)

    def add(self, words: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        if len(self.words) + len(words) > KEPT_WORDS:
            self.__init__()
        first = len(self.ids)
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.concatenate([self.start, first + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def without_rare(self) -> _Words:
        """The words that came again, if they leave room for as many others."""
        out = _Words()
        if 2 * int(self.again.sum()) <= KEPT_WORDS:
            size = self.size[self.again]
            out.add(self.words.filter(pa.array(self.again)), size, self.ids[np.repeat(self.again, self.size)])
        return out


class Encoder:
    """Encodes arrays of texts; ``kind`` is the rule by which texts are cut."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = self._rule(json.loads(self.tokenizer.to_str()))
        self.kept = _Words()
        if self.kind == "lead":
            size = self.tokenizer.get_vocab_size()
            self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        if self.kind == "drop":
            self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
            if len(self.mark) != 1:
                self.kind = "whole"

    def _rule(self, spec: dict) -> str:
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        plain = all(not x.get("normalized") and x["content"].split() == [x["content"]] for x in spec.get("added_tokens", []))
        if not self.small or not plain or (spec.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel":
            return "whole"
        if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return "lead"
        split, *rest = before.get("pretokenizers") or [{}]
        words = split.get("type") == "Split" and split.get("pattern") == {"Regex": _DROP_WORDS} and split.get("behavior") == "Removed" and split.get("invert")
        bytes_ = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("use_regex") and not rest[0].get("add_prefix_space")
        if words and bytes_ and (norm or {}).get("normalizers") == _DROP_STEPS:
            return "drop"
        return "whole"

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded whole."""
        found = pc.match_substring_regex(texts, _WIDE if self.kind == "lead" else r"\x01|[A-Z]\p{M}")
        for x in self.added:
            # Where words are made small before they are encoded, a mark in capitals would become one.
            found = pc.or_(found, pc.match_substring(texts, x, ignore_case=self.kind == "drop"))
        return found.to_numpy(zero_copy_only=False)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        return size, flat

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, encoded as a few long texts."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        between = " " if self.kind == "lead" else f" {_MARK} "
        at = pa.array(np.r_[np.arange(0, len(words), _JOINED), len(words)].astype(np.int32))
        long = pc.binary_join(pa.ListArray.from_arrays(at, words), between)
        parts = []
        for i in range(0, len(long), 32):  # an encoding holds far more than its ids
            some = [between + x if self.kind == "lead" else x + between for x in long.slice(i, 32).to_pylist()]
            parts += [np.array(x.ids, np.uint16) for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        ids = np.concatenate(parts)
        del parts
        if self.kind == "lead":
            first = np.flatnonzero(self.leads[ids])
            size = np.diff(np.r_[first, len(ids)])
        else:
            end = np.flatnonzero(ids == self.mark[0])
            size = np.diff(np.r_[-1, end]) - 1
            ids = ids[ids != self.mark[0]]
        if len(size) != len(words):
            raise AssertionError(f"{len(words)} words gave {len(size)} parts")
        return size, ids

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Keep the ids of new words; returns the words' places."""
        if self.kind == "lead":
            apart = pc.or_(pc.equal(new, ""), pc.match_substring_regex(new, rf"^\x01|[{_SPACE}]$"))
        else:
            apart = pc.match_substring(new, _MARK)
        alone = new.filter(apart).to_pylist()
        if self.kind == "lead":
            alone = [w[1:] if w[:1] == _MARK else f" {w}" for w in alone]
        apart = apart.to_numpy(zero_copy_only=False)
        size = np.zeros(len(new), np.int64)
        size[apart], own = self._whole(alone) if alone else (0, np.zeros(0, np.uint32))
        size[~apart], rest = self._joined(new.filter(pa.array(~apart)))
        order = np.r_[np.flatnonzero(apart), np.flatnonzero(~apart)]
        self.kept.add(new.take(pa.array(order)), size[order], np.concatenate([own.astype(np.uint16), rest]))
        place = np.empty(len(new), np.int64)
        place[order] = len(self.kept.words) - len(new) + np.arange(len(new))
        return place

    def _by_word(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.kind == "drop":
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            texts = pc.replace_substring_regex(texts, r"([a-z])([.,])( |$)", r"\1 \2\3")
        else:
            texts = pc.binary_join_element_wise(_MARK, texts, "")
        split = pc.split_pattern(texts, " ")
        at, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
        at -= at[0]
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        found = pc.index_in(distinct, value_set=self.kept.words)
        if found.null_count and len(self.kept.words) + found.null_count > KEPT_WORDS:
            self.kept = self.kept.without_rare()
            found = pc.index_in(distinct, value_set=self.kept.words)
            if len(self.kept.words) + found.null_count > KEPT_WORDS:
                self.kept = _Words()
                found = pa.nulls(len(distinct), pa.int32())
        place = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = found.is_null().to_numpy(zero_copy_only=False)
        self.kept.again[place[~new]] = True
        if new.any():
            place[new] = self._learn(distinct.filter(pa.array(new)))
        place = place[codes]
        size = self.kept.size[place]
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
        lo, after = 0, ends[at]
        while lo < len(texts):  # some texts at a time
            hi = max(lo + 1, int(np.searchsorted(after, after[lo] + _GATHER, "right")) - 1)
            a, b = at[lo], at[hi]
            n = size[a:b]
            total = int(ends[b] - ends[a])
            from_ = np.repeat(self.kept.start[place[a:b]] - (ends[a:b] - ends[a]), n) + np.arange(total)
            yield np.diff(after[lo : hi + 1]), self.kept.ids[from_].astype(np.uint32)
            lo = hi

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts, in order, of (ids of each text, all of these ids)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.kind == "whole":
            yield self._whole(texts.to_pylist())
            return
        odd = self._odd(texts)
        cuts = np.r_[0, np.flatnonzero(np.diff(odd)) + 1, len(odd)] if len(odd) else [0]
        for a, b in zip(cuts, cuts[1:]):
            part = texts.slice(a, b - a)
            if odd[a]:
                yield self._whole(part.to_pylist())
            else:
                yield from self._by_word(part)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BLOCK_BYTES`` of text (column ``text``)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def put_out() -> pa.RecordBatch:
        give_back()
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            done = int(of[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(of, done + BLOCK_BYTES - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(of[hi - 1]) - done
            lo = hi
            if size >= BLOCK_BYTES or lo < batch.num_rows:
                yield put_out()
                held, size = [], 0
    if held:
        yield put_out()
    give_back()
