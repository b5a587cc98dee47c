"""Fast exact byte-level BPE for tasks: the tokenizers library encodes each distinct word of a batch, and known stems come from a bounded cache."""

from __future__ import annotations

import functools
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD_SPACE = re.compile(r" (?:\s|$)")
SAFE_SPLIT = re.compile(r" (?=\S)")
MARKS = "".join(c for c in string.punctuation if c != "'")
STEM_AND_MARKS = rf"^(?P<stem>\pL+)(?P<marks>[{re.escape(MARKS)}]*)$"
LARGE = pa.large_string()
#: Characters of the texts that are encoded at once
BATCH_CHARS = 12_000_000


def spelling() -> list[str]:
    """The byte alphabet by its rule: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on. A line feed is set off by spaces."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    out = [chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)]
    out[10] = f" {out[10]} "
    return out


SPELLING = spelling()


def spelt(text: str) -> str:
    return text.encode().decode("latin-1").translate(SPELLING)


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of the pool that the codes name, one after another, and where each begins (one more entry: the end)."""
    n = size[codes]
    upto = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    at = np.repeat(start[codes] - upto[:-1], n)
    at += np.arange(upto[-1])
    return pool[at], upto


def flags(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


class Pool:
    """Id sequences, one after another, with where each begins and how many ids it has."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.ids = np.concatenate([np.empty(0, "<u4"), *(i for i, _ in parts)])
        self.size = np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)])
        self.start = np.cumsum(self.size) - self.size

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.ids, self.start, self.size, codes)[0], self.size[codes]


class Known:
    """Stems met before and their ids, at most `limit`; beyond that only the last batch's stay."""

    def __init__(self, limit: int):
        self.limit, self.stems, self.pool = limit, pa.array([], LARGE), Pool([])

    def look_up(self, stems: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stems, one after another, and how many each has; `encode` gives those of new ones."""
        place = pc.index_in(stems, value_set=self.stems)
        new = stems.filter(pc.is_null(place))
        if len(new):
            fresh = encode(new)
            at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at[at < 0] = len(self.stems) + np.arange(len(new))
            self.stems = pa.concat_arrays([self.stems, new])
            self.pool = Pool([(self.pool.ids, self.pool.size), fresh])
        else:
            at = place.to_numpy(zero_copy_only=False).astype(np.int64)
        got = self.pool.take(at)
        if len(self.stems) > self.limit:
            self.stems, self.pool = stems, Pool([got])
        return got


class Encoder:
    """Ids of whole texts as arrays of unsigned 32-bit integers, with `end_id` appended; equal to the library's plain call.

    The pre-tokenizer always starts a new piece at a space that stands before a visible character, and at a line feed
    between visible ones, so a text is cut there and each part is encoded on its own; a word and its trailing
    punctuation are two pieces as well. Parts that hold any other white space are left to the library, and so is a whole text with
    one of the tokenizer's added tokens (`special_as_text` takes these for ordinary characters). No part is capped.
    """

    def __init__(self, path: str, end_id: int = 2, known: int = 800_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        added = [t.content for t in self.lib.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = "|".join(map(re.escape, added))
        # the same merges without the splitting pattern, for pieces already cut and spelt in the byte alphabet
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.end_id = end_id
        self.newline = self.library("\n")
        #: stems after a space, and stems that begin a text or a line
        self.known = (Known(known), Known(known // 4))

    def library(self, text: str) -> np.ndarray:
        """The library's own answer, without any cache."""
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.library(t) for t in texts]
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _parted(self, lib, words: pa.Array, spell, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that hold no white space, each after `lead`, one after another, and how many each has.

        A thousand go in one text, one to a line; the line feeds' ids part them, so no word is touched one by one."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        offsets = np.append(np.arange(0, len(words), 1000), len(words))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words), pa.scalar("\n" + lead, LARGE))
        ids = np.concatenate([np.array(lib.encode_batch_fast([spell(f"{lead}{t.as_py()}\n")], add_special_tokens=False)[0].ids, "<u4") for t in texts])
        stop = np.flatnonzero(ids == self.newline[0])
        if len(stop) != len(words):
            raise ValueError("this tokenizer joins line feeds with other characters")
        return np.delete(ids, stop), np.diff(stop, prepend=-1) - 1

    def _pieces(self, pieces: pa.Array, first: bool) -> tuple[Pool, np.ndarray]:
        """For distinct pieces without white space, after a space or (`first`) after none: a pool, and its two parts that make up each piece
        (stem and marks, or the whole piece and nothing)."""
        lead = "" if first else " "
        # letters of later Unicode versions may be unknown to the library: with any beyond U+052F the whole word is left to it
        found = pc.extract_regex(pieces, STEM_AND_MARKS)
        plain = flags(pc.and_(pc.is_valid(found), pc.match_substring_regex(pieces, r"^[\x{0}-\x{52F}]*$")))
        split, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        stem, mark = (found.field(k).take(pa.array(split)).dictionary_encode() for k in (0, 1))
        marks = self._whole(mark.dictionary.to_pylist())
        stems = self.known[first].look_up(stem.dictionary, lambda new: self._parted(self.merges, new, spelt, lead))
        pool = Pool([stems, marks, self._parted(self.lib, pieces.take(pa.array(other)), str, lead), (np.empty(0, "<u4"), np.zeros(1, np.int64))])
        k, m = len(stem.dictionary), len(mark.dictionary)
        parts = np.full((len(pieces), 2), len(pool.size) - 1)
        parts[split, 0], parts[split, 1] = stem.indices.to_numpy(), k + mark.indices.to_numpy()
        parts[other, 0] = k + m + np.arange(len(other))
        return pool, parts

    def _words(self, words: pa.Array, first: bool) -> Pool:
        """Ids of distinct words, each after a space or (`first`) at the start of its text."""
        has_space = flags(pc.match_substring(words, " "))
        clear = flags(pc.utf8_is_printable(words)) & ~has_space & (pc.binary_length(words).to_numpy() > 0)
        simple = np.flatnonzero(clear)
        broken = np.flatnonzero(flags(pc.match_substring(words, "\n")) & ~has_space)
        lines = pc.split_pattern(words.take(pa.array(broken)), "\n")
        at, line = lines.offsets.to_numpy().astype(np.int64), lines.flatten()
        # single line feeds and pairs of them are pieces of one id each where visible characters follow
        empty = pc.binary_length(line).to_numpy() == 0
        head = np.zeros(len(line), bool)
        head[at[:-1]] = True
        bad = ~flags(pc.utf8_is_printable(line)) & ~empty | empty & (head | np.r_[False, empty[:-1]])
        fine = ~(np.add.reduceat(bad, at[:-1]) > 0) if len(broken) else np.empty(0, bool)
        inside = np.repeat(fine, np.diff(at))
        text, head = line.filter(pa.array(inside)), head[inside]
        broken, rows = broken[fine], np.diff(at)[fine]
        left = np.ones(len(words), bool)
        left[simple] = left[broken] = False
        rest = np.flatnonzero(left)
        # rows of pieces: line feed or nothing, stem, marks
        all_pieces = pa.concat_arrays([words.take(pa.array(simple)), text])
        alone = np.r_[np.full(len(simple), first), np.where(head, first, True)].astype(bool)
        feed = np.r_[np.zeros(len(simple), bool), ~head]
        parts, pools, table, offset = [], [(self.newline, np.ones(1, np.int64)), (np.empty(0, "<u4"), np.zeros(1, np.int64))], np.ones((len(all_pieces), 3), np.int64), 2
        for kind in (False, True):
            who = np.flatnonzero(alone == kind)
            if len(who):
                coded = all_pieces.take(pa.array(who)).dictionary_encode()
                full = pc.binary_length(coded.dictionary).to_numpy() > 0
                pool, two = self._pieces(coded.dictionary.filter(pa.array(full)), kind)
                both = np.ones((len(full), 2), np.int64)
                both[full] = two + offset
                table[who, 1:] = both[coded.indices.to_numpy()]
                pools.append((pool.ids, pool.size))
                offset += len(pool.size)
        table[feed, 0] = 0
        pool = Pool(pools)
        ids, upto = gathered(pool.ids, pool.start, pool.size, table.ravel())
        odd, odd_size = self._whole([("" if first else " ") + w for w in words.take(pa.array(rest)).to_pylist()])
        ends = np.cumsum(np.r_[np.ones(len(simple), np.int64), rows]) * 3
        size = np.empty(len(words), np.int64)
        size[np.concatenate([simple, broken])] = np.diff(upto[np.r_[0, ends]])
        size[rest] = odd_size
        order = np.concatenate([simple, broken, rest]).astype(np.int64)
        out = Pool([])
        out.ids, out.size = np.concatenate([ids, odd]), size
        out.start = np.empty(len(words), np.int64)
        out.start[order] = np.cumsum(size[order]) - size[order]
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (an Arrow array or a series of strings) one after another, and where each text begins (one more entry: the end). Null is the empty text."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(["" if t is None else t for t in texts], LARGE)).cast(LARGE).fill_null("")
        n = len(texts)
        whole = flags(pc.match_substring_regex(texts, self.added)) if self.added else np.zeros(n, bool)
        odd = np.flatnonzero(whole | flags(pc.match_substring_regex(texts, r" (?:[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]|$)")))
        lists = pc.split_pattern(texts, " ").cast(pa.large_list(LARGE))
        if len(odd):
            rare = [[t] if whole[i] else SAFE_SPLIT.split(t) for i, t in zip(odd, texts.take(pa.array(odd)).to_pylist())]
            place = np.arange(n)
            place[odd] = n + np.arange(len(odd))
            lists = pa.concat_arrays([lists, pa.array(rare, pa.large_list(LARGE))]).take(pa.array(place))
        at, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        at = at - at[0]
        heads, coded = flat.take(pa.array(at[:-1])).dictionary_encode(), flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        is_head = np.zeros(len(flat), bool)
        is_head[at[:-1]] = True
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[~is_head]] = True
        number = np.cumsum(used) - 1
        codes = number[codes]
        words, starts = self._words(coded.dictionary.filter(pa.array(used)), False), self._heads(heads.dictionary, heads.indices.to_numpy(), whole)
        codes[is_head] = len(words.size) + heads.indices.to_numpy()
        pool = Pool([])
        pool.ids = np.concatenate([words.ids, starts.ids, np.array([self.end_id], "<u4")])
        pool.size = np.concatenate([words.size, starts.size, [1]])
        pool.start = np.concatenate([words.start, len(words.ids) + starts.start, [len(words.ids) + len(starts.ids)]])
        codes = np.insert(codes, at[1:], len(pool.size) - 1)
        ids, upto = gathered(pool.ids, pool.start, pool.size, codes)
        return ids, upto[at + np.arange(len(at))]

    def _heads(self, heads: pa.Array, codes: np.ndarray, whole: np.ndarray) -> Pool:
        """Ids of the texts' first words; texts that the library takes whole stand as one such word."""
        apart = np.zeros(len(heads), bool)
        apart[codes[whole]] = True
        if not apart.any():
            return self._words(heads, True)
        some = self._words(heads.filter(pa.array(~apart)), True)
        ids, size = self._whole(heads.filter(pa.array(apart)).to_pylist())
        out = Pool([])
        out.ids, out.size, out.start = np.concatenate([some.ids, ids]), np.empty(len(heads), np.int64), np.empty(len(heads), np.int64)
        out.size[~apart], out.start[~apart] = some.size, some.start
        out.size[apart], out.start[apart] = size, len(some.ids) + np.cumsum(size) - size
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int = 2) -> Encoder:
    """The encoder of this worker process; its cache serves all tasks that the process runs."""
    return Encoder(path, end_id)


def runs_of(texts: pa.Array, most: int = BATCH_CHARS) -> list[tuple[int, int]]:
    """The array's rows in runs of at most `most` bytes of text (or one row), so that what one call of `encode` holds is bounded."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    out, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        out.append((a, b))
        a = b
    return out
