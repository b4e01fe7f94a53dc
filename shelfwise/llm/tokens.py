"""Token ids of whole texts by the ``tokenizers`` library, for use inside tasks.

White space bounds every match of the two kinds of pre-tokenizers known here, so a text's ids are the ids of its
words one after another. A batch of texts is cut into words and its distinct words are found in Arrow; the library
encodes those that the worker doesn't remember, up to a bound, and numpy puts the ids in place. Any other tokenizer
file, and any text with unusual white space, is encoded whole.

The library's defaults hold, without the special tokens that it would add: the name of one within a text is its one id.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Words that a worker remembers; beyond it, it begins anew and takes over what it meets again.
REMEMBERED = 120_000
#: Bytes of the texts that are encoded at a time, each distinct word once; a longer text is a batch of its own.
BATCH_BYTES = 6_000_000

#: White space other than single spaces and line feeds between words, and what Python or the library alone count so.
_OTHER = r"[\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that are taken off the end of a word (an apostrophe may begin a piece of its own kind), and words joined at a time.
_MARKS, JOINED = "".join(c for c in string.punctuation if c != "'"), 50
#: Letters up to U+024F, as the last of a text. Those that stay one letter in lower case make a word that is one piece.
_LETTERS = [c for c in map(chr, range(ord("A"), 0x250)) if c.isalpha()]
_LETTER_LAST = "[" + "".join(_LETTERS) + r"]\z"
_ONLY_LETTERS = r"\A[" + "".join(c for c in _LETTERS if len(c.lower()) == 1) + r"]+\z"
_UNUSUAL = _OTHER + r"|^[ \n]|[ \n]$|[ \n][ \n]"
_encoders: dict[str, TextEncoder] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = _kind(spec)
        names = {c for token in spec.get("added_tokens") or [] for c in token["content"]}
        self.marks = "".join(c for c in _MARKS if c not in names)
        # joined words are told apart by ids that hold the space before a word, or that end one
        vocabulary = self.tokenizer.get_vocab()
        self.bounds = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.kind == "led":
            self.joiner = self.tokenizer
            self.bounds[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        elif self.kind == "free":
            # a word of letters is one piece that needs no normalizing but its lower case
            self.joiner = Tokenizer(self.tokenizer.model)
            split = pre_tokenizers.Split(" ", "removed")
            letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.joiner.pre_tokenizer = pre_tokenizers.Sequence([split, letters])
            self.bounds[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.remembered = remembered
        self.known, self.older = _no_ids(), _no_ids()

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, encoded as it is, as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin and end; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if self.kind is None:
            odd = np.ones(len(texts), bool)
        elif self.kind == "led":
            odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        else:
            odd = np.zeros(len(texts), bool)
        usual = texts.filter(pa.array(~odd)) if odd.any() else texts
        ids, sizes = self._by_words(usual)
        if odd.any():
            parts = np.split(ids, np.cumsum(sizes)[:-1]) if len(usual) else []
            whole = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
            rest = iter(parts)
            docs = [np.frombuffer(next(whole), "<u4") if o else next(rest) for o in odd.tolist()]
            ids, sizes = np.concatenate([np.zeros(0, np.uint32), *docs]), np.array([len(d) for d in docs], np.int64)
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.kind == "led":
            # a word carries the white space before it: "x" stands for " x", a null byte for the text's start
            spaced = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
        else:
            spaced = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(spaced, " ")
        words = lists.flatten().dictionary_encode()
        ids, counts = self._word_ids(words.dictionary.cast(pa.string())).take(words.indices.to_numpy())
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        return ids, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def _word_ids(self, words: pa.Array) -> Ids:
        """Ids of distinct words. They stay in Arrow and numpy: most words are rare, and each would be several objects."""
        known = self.known
        at = _places(words, known.words)
        new = at < 0
        if new.any():
            learnt = self._learn(words.filter(pa.array(new)))
            at[new] = len(known.words) + np.arange(new.sum())
            both = known.plus(learnt)
            if len(both.words) > self.remembered:
                self.known, self.older = learnt, known
            else:
                self.known = both
            known = both
            pa.default_memory_pool().release_unused()
        return Ids(words, *known.take(at))

    def _learn(self, new: pa.Array) -> Ids:
        """Ids of words not met before, in their order, and behind them those of their parts.

        Such a word is its letters and the marks behind them, where the pre-tokenizer cuts anyway.
        """
        stems = pc.utf8_rtrim(new, characters=self.marks)
        ended = pc.and_(pc.not_equal(stems, new), pc.match_substring_regex(stems, _LETTER_LAST))
        marks = _behind(new.filter(ended), stems.filter(ended))
        if self.kind == "led":
            marks = pc.binary_join_element_wise("\0", marks, "")
        first = pc.if_else(ended, stems, new)
        coded = pa.concat_arrays([first, marks]).dictionary_encode()
        wanted, code = coded.dictionary, coded.indices.to_numpy()
        in_known, in_older = _places(wanted, self.known.words), _places(wanted, self.older.words)
        unknown = (in_known < 0) & (in_older < 0)
        held = self.known.plus(self.older)
        at = np.where(in_known >= 0, in_known, len(self.known.words) + in_older)
        at[unknown] = len(held.words) + np.arange(unknown.sum())
        parts = Ids(wanted, *held.plus(self._ask(wanted.filter(pa.array(unknown)))).take(at))

        two = ended.to_numpy(zero_copy_only=False)
        begins = np.arange(len(new)) + np.cumsum(two) - two
        places = np.zeros(len(new) + two.sum(), np.int64)
        places[begins], places[begins[two] + 1] = code[: len(new)], code[len(new) :]
        values, counts = parts.take(places)
        found = Ids(new, values, np.add.reduceat(counts, begins))
        more = np.flatnonzero((in_known < 0) & (_places(wanted, new) < 0))
        return found.plus(Ids(wanted.take(pa.array(more)), *parts.take(more)))

    def _ask(self, words: pa.Array) -> Ids:
        """Ids of words from the library, many in one text where the ids show the words' bounds."""
        if self.kind == "led":
            starts = pc.or_(pc.starts_with(words, "\0"), pc.starts_with(words, "\n"))
            joined = pc.and_(pc.invert(starts), pc.greater(pc.binary_length(words), 0))
        else:
            joined = pc.match_substring_regex(words, _ONLY_LETTERS)
        chosen = words.filter(joined)
        cuts = np.append(np.arange(0, len(chosen), JOINED), len(chosen)).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), chosen if self.kind == "led" else pc.utf8_lower(chosen)), " ")
        if self.kind == "led":
            runs = pc.binary_join_element_wise(" ", runs, "")
        encoded = [np.array(x.ids, "<u4") for x in self.joiner.encode_batch_fast(runs.to_pylist(), add_special_tokens=False)]
        values, sizes = np.concatenate([np.zeros(0, "<u4"), *encoded]), np.array([len(x) for x in encoded], np.int64)
        bound = self.bounds[values]
        ends = np.cumsum(sizes)
        seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(bound)])
        # as many bounds as words, one of them where the run begins or ends
        outer = np.append(bound, False)[ends - sizes if self.kind == "led" else ends - 1]
        clear = (seen[ends] - seen[ends - sizes] == np.diff(cuts)) & (sizes > 0) & outer
        keep = np.repeat(clear, sizes)
        values, at = values[keep], np.flatnonzero(bound[keep])
        counts = np.diff(np.append(at, len(values)) if self.kind == "led" else np.concatenate([np.zeros(1, np.int64), at + 1]))

        by_run = joined.to_numpy(zero_copy_only=False).copy()
        by_run[by_run] = np.repeat(clear, np.diff(cuts))
        single = np.flatnonzero(~by_run)
        texts = words.take(pa.array(single)).to_pylist()
        whole = self.whole([_chunk(w) for w in texts] if self.kind == "led" else texts)
        order = np.zeros(len(words), np.int64)
        order[np.flatnonzero(by_run)], order[single] = np.arange(len(counts)), len(counts) + np.arange(len(single))
        values = np.concatenate([values, np.frombuffer(b"".join(whole), "<u4")])
        counts = np.concatenate([counts, np.array([len(x) // 4 for x in whole], np.int64)])
        return Ids(words, *_take(values, counts, order))


@dataclass(frozen=True)
class Ids:
    """Distinct words and their ids: ``values`` of one word after another, ``counts`` of each."""

    words: pa.Array
    values: np.ndarray
    counts: np.ndarray

    def plus(self, other: Ids) -> Ids:
        columns = [(self.values, other.values), (self.counts, other.counts)]
        return Ids(pa.concat_arrays([self.words, other.words]), *map(np.concatenate, columns))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _take(self.values, self.counts, at)


def _no_ids() -> Ids:
    return Ids(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))


def _take(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``values``, one after another, and their lengths."""
    begins, taken = np.cumsum(counts) - counts, counts[at]
    ends = np.cumsum(taken)
    shift = (begins[at] - ends + taken).astype(np.int32)
    return values[np.repeat(shift, taken) + np.arange(taken.sum(), dtype=np.int32)], taken


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each of ``words`` stands ``among`` others, -1 for none."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _behind(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows the stem in each word."""
    sizes, cut = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, stems))
    # bytes of a word: its stem's, then those behind it
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    counts = np.stack([cut, sizes - cut], axis=1).ravel()
    found, lengths = _take(data, counts, np.arange(1, len(counts), 2))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(found)))


def _chunk(word: str) -> str:
    return word[1:] if word[:1] == "\0" else word if word[:1] == "\n" else " " + word


def _kind(spec: dict) -> str | None:
    """``led``: byte-level words that carry the space before them. ``free``: white space is dropped."""
    before, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if before is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return "led"
    steps = [x.get("type") for x in (before or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and parts and parts[0].get("behavior") == "Removed" and parts[0]["invert"]:
        return "free"
    return None


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def in_batches(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of batches of texts that are short together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)
