"""Exact, memoised encoding of whole texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import regex

#: Units longer than this are encoded each time: they are rare and would fill the memory.
LONGEST_KEPT = 64
#: Longer texts are encoded in stretches of about so many characters.
STRETCH = 4_000_000
#: New units in one call of the library.
CALL = 8192

#: Fixed value: the pieces that the byte-level BPE model is applied to.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The letter that stands for a space in a byte-level vocabulary.
SPACE = "Ġ"
#: Behind a word these are pieces of their own.
TAILS = (".", ",")

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Letters and digits of these scripts are classed alike by every Unicode version.
_STABLE = re.compile(r"[\x00-ɏ]*").fullmatch
_ENCODERS: dict[tuple, BytePairEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of each start and size, one after another."""
    total, kind = int(sizes.sum()), np.int32 if len(pool) + sizes.sum() < 1 << 31 else np.int64
    at = np.repeat((starts - np.cumsum(sizes) + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return pool[at]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts of these sizes, each followed by an end id; the new sizes."""
    sizes = sizes + 1
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = ids
    return out, sizes


def _model(path: str):
    """The file's model without the library's own cache, which new units only fill."""
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        settings = json.load(f)["model"]
    settings = {k: v for k, v in settings.items() if k != "type" and v is not None}
    settings["merges"] = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in settings["merges"]]
    return models.BPE(**settings, cache_capacity=0)


class BytePairEncoder:
    """Encodes texts into ids, equal to the tokenizers library's.

    The pattern always starts a new piece at a space that has other than white space on both sides,
    so texts are cut there into units, and each distinct unit of a batch is encoded once; the ids of
    up to `capacity` units are remembered. A plain split at spaces cuts so unless white space meets a
    space: then a unit is empty or has white space at an end, and a pattern cuts that text instead.
    A full stop or comma behind a word is a piece of its own, so such a unit shares the word's ids.

    New units are encoded by the library in bulk: words of Latin letters as one run of pieces, to
    which the library applies its model alone; the first id of a word is one that begins with a
    space, and no other is. So are other units of Latin characters, with a mark between their pieces.
    Any other unit goes through the library's whole pipeline.
    """

    def __init__(self, path: str, capacity: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model = _model(path)
        self.words, self.marked = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(SPACE, "merged_with_next")
        self.marked.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        for coder in (self.tokenizer, self.words, self.marked):
            coder.encode_special_tokens = True
        # 0xFF is no byte of UTF-8: it stands between pieces
        self.letters = byte_letters() | {255: "\n"}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.opens[at] = token.startswith(SPACE)
        self.tails = [np.array(self._whole(c), np.uint32) for c in TAILS]
        self.capacity = capacity
        self._forget()

    def _forget(self) -> None:
        import pyarrow as pa

        self.known = pa.array([], pa.string())
        self.pool, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    # ------------------------------------------------------------ units

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bulk(self, coder, pieces: str, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of so many units, and their number by unit."""
        ids = np.array(coder.encode_batch_fast([pieces], add_special_tokens=False)[0].ids, np.uint32)
        heads = np.flatnonzero(self.opens[ids])
        if len(heads) != count:
            raise ValueError(f"{count} units gave {len(heads)} runs of ids")
        return ids, np.diff(heads, append=len(ids))

    def _new(self, units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_some of all units, so many at a time: the library's answer takes much more memory than the ids."""
        made = [self._some(units.slice(at, CALL)) for at in range(0, len(units), CALL)]
        ids, at, sizes = (np.concatenate(x) for x in zip(*made, strict=True))
        lengths = [len(m[0]) for m in made]
        return ids, at + np.repeat(np.cumsum(lengths) - lengths, [len(m[1]) for m in made]), sizes

    def _some(self, units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and sizes of an Arrow array of units, each with a space before it; a unit that white space borders or a space cuts has -1 for its size."""
        import pyarrow as pa
        import pyarrow.compute as pc

        parts, sizes, at, base = [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        plain = pc.ascii_is_alpha(units).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        odd, words, runs, pieces, others = [], [], [], [], []
        for k, u in zip(rest.tolist(), units.take(pa.array(rest)).to_pylist(), strict=True):
            if not u or " " in u or u[0].isspace() or u[-1].isspace():
                odd.append(k)
            elif not (u.isascii() or _STABLE(u)):
                others.append((k, u))
            elif u.isalpha():
                words.append((k, u))
            else:
                runs.append(k)
                pieces += PIECES.findall(" " + u)
        made = []
        if plain.any():
            found = units.filter(pa.array(plain)).to_pylist()
            made.append((np.flatnonzero(plain), self._bulk(self.words, SPACE + SPACE.join(found), len(found))))
        if words:
            text = " " + " ".join([u for _, u in words])
            made.append(([k for k, _ in words], self._bulk(self.words, text.encode().decode("latin-1").translate(self.letters), len(words))))
        if runs:
            text = b"\xff".join([p.encode() for p in pieces]).decode("latin-1").translate(self.letters)
            made.append((runs, self._bulk(self.marked, text, len(runs))))
        for k, u in others:
            ids = np.array(self._whole(" " + u), np.uint32)
            made.append(([k], (ids, np.array([len(ids)]))))
        for which, (ids, n) in made:
            sizes[which], at[which] = n, base + np.cumsum(n) - n
            base += len(ids)
            parts.append(ids)
        sizes[odd] = -1
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), at, sizes

    def _look_up(self, units, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and the start and size of each unit there. times: how often each occurs."""
        import pyarrow as pa
        import pyarrow.compute as pc

        place = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        if not len(unknown):
            return self.pool, self.starts[place], self.sizes[place]
        fresh = units.take(pa.array(unknown))
        ids, at, n = self._new(fresh)
        starts, sizes = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        old = place >= 0
        starts[old], sizes[old] = self.starts[place[old]], self.sizes[place[old]]
        starts[unknown], sizes[unknown] = at + len(self.pool), n
        pool = np.concatenate((self.pool, ids))
        if 2 * len(self.known) > self.capacity and 2 * times[unknown].sum() > times.sum():  # other words than those remembered
            self._forget()
        # when half of the room would be taken, only units that came twice in a batch are kept
        keep = (n >= 0) & (pc.binary_length(fresh).to_numpy() <= LONGEST_KEPT)
        if 2 * (len(self.known) + len(unknown)) > self.capacity:
            keep &= times[unknown] > 1
        keep = np.flatnonzero(keep)[: self.capacity - len(self.known)]
        if len(keep):
            self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(n[keep]) - n[keep]))
            self.sizes = np.concatenate((self.sizes, n[keep]))
            self.pool = np.concatenate((self.pool, gather(ids, at[keep], n[keep])))
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
        return pool, starts, sizes

    def _distinct(self, units, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_look_up of words with a full stop or comma behind by the word alone."""
        import pyarrow as pa
        import pyarrow.compute as pc

        stems, tail = units, np.zeros(len(units), np.int64)
        for i, c in enumerate(TAILS):
            with_tail = np.flatnonzero(pc.ends_with(units, c).to_numpy(zero_copy_only=False))
            bare = pc.utf8_slice_codeunits(units.take(pa.array(with_tail)), 0, -1)
            word = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
            tail[with_tail[word]] = i + 1
            mask = np.zeros(len(units), bool)
            mask[with_tail[word]] = True
            stems = pc.replace_with_mask(stems, pa.array(mask), bare.filter(pa.array(word)))
        coded = pc.dictionary_encode(stems)
        order = coded.indices.to_numpy()
        pool, starts, sizes = self._look_up(coded.dictionary, np.bincount(order, times, len(coded.dictionary)))
        starts, sizes = starts[order], sizes[order]
        if not tail.any():
            return pool, starts, sizes
        odd = sizes < 0
        # two runs of ids a unit: the word's, and the tail's
        first = len(pool) + np.cumsum([0, *map(len, self.tails)])
        length = np.array([0, *map(len, self.tails)])
        both = np.stack((np.maximum(sizes, 0), length[tail]), 1)
        made = gather(np.concatenate((pool, *self.tails)), np.stack((starts, first[np.maximum(tail, 1) - 1]), 1).reshape(-1), both.reshape(-1))
        sizes = both.sum(axis=1)
        return made, np.cumsum(sizes) - sizes, np.where(odd, -1, sizes)

    # ------------------------------------------------------------ texts

    def _runs(self, units, heads: np.ndarray, opened: np.ndarray):
        """Ids and their number of each run of units that begins at `heads`; None and the odd runs if there are some.

        opened: runs whose first unit has no space before it.
        """
        import pyarrow.compute as pc

        coded = pc.dictionary_encode(units)
        order = coded.indices.to_numpy()
        pool, starts, sizes = self._distinct(coded.dictionary, np.bincount(order, minlength=len(coded.dictionary)))
        starts, sizes = starts[order], sizes[order]
        if (sizes < 0).any():
            return None, np.logical_or.reduceat(sizes < 0, heads)
        firsts = heads[opened]
        if len(firsts):
            parts, base, known = [pool], len(pool), {}
            for at in firsts.tolist():
                unit = units[at].as_py()
                if unit not in known:
                    parts.append(np.array(self._whole(unit), np.uint32))
                    known[unit] = (base, len(parts[-1]))
                    base += len(parts[-1])
                starts[at], sizes[at] = known[unit]
            pool = np.concatenate(parts)
        return gather(pool, starts, sizes), np.add.reduceat(sizes, heads)

    def _cut(self, texts: list[str], opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of texts in which white space meets a space."""
        import pyarrow as pa

        cut = [_LONE_SPACE.split(t) for t in texts]
        n = np.array([len(c) for c in cut], np.int64)
        units = pa.array([u for c in cut for u in c], pa.string())
        heads = np.cumsum(n) - n
        coded = units.dictionary_encode()
        order = coded.indices.to_numpy()
        pool, starts, sizes = self._distinct(coded.dictionary, np.bincount(order, minlength=len(coded.dictionary)))
        starts, sizes = starts[order], sizes[order]
        # the odd units are at borders or hold a run of white space: these go through the whole pipeline
        whole = sizes < 0
        whole[heads[opened]] = True
        parts, base = [pool], len(pool)
        first = set(heads[opened].tolist())
        for at in np.flatnonzero(whole).tolist():
            parts.append(np.array(self._whole(units[at].as_py() if at in first else " " + units[at].as_py()), np.uint32))
            starts[at], sizes[at] = base, len(parts[-1])
            base += len(parts[-1])
        return gather(np.concatenate(parts), starts, sizes), np.add.reduceat(sizes, heads)

    def _texts(self, texts, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        split = pc.split_pattern(texts, " ")
        heads = split.offsets.to_numpy()[:-1].astype(np.int64)
        found, sizes = self._runs(split.flatten(), heads - heads[0], opened)
        if found is not None:
            return found, sizes
        odd = sizes
        ids, sizes_odd = self._cut(texts.filter(pa.array(odd)).to_pylist(), opened[odd])
        rest, sizes_rest = self._texts(texts.filter(pa.array(~odd)), opened[~odd])
        sizes = np.empty(len(odd), np.int64)
        sizes[odd], sizes[~odd] = sizes_odd, sizes_rest
        out, where = np.empty(len(ids) + len(rest), np.uint32), np.repeat(odd, sizes)
        out[where], out[~where] = ids, rest
        return out, sizes

    def _stretches(self, text: str) -> Iterator[str]:
        """A long text, cut at spaces between others than white space; these spaces are left out."""
        start = 0
        while len(text) - start > STRETCH and (m := _LONE_SPACE.search(text, start + STRETCH)):
            yield text[start : m.start()]
            start = m.end()
        yield text[start:]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (an Arrow array or a list; null is empty) one after another, and their number by text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        long = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 2 * STRETCH).tolist()
        if not long:
            return self._texts(texts, np.ones(len(texts), bool))
        ids, sizes, at = [], [], 0
        for k in [*long, len(texts)]:
            part = self._texts(texts.slice(at, k - at), np.ones(k - at, bool))
            ids.append(part[0])
            sizes += part[1].tolist()
            if k < len(texts):
                made = [self._texts(pa.array([s]), np.array([i == 0]))[0] for i, s in enumerate(self._stretches(texts[k].as_py()))]
                ids += made
                sizes.append(sum(map(len, made)))
            at = k + 1
        return np.concatenate(ids), np.array(sizes, np.int64)


def encoder(path: str) -> BytePairEncoder:
    """One encoder a process: it outlives a task where Spark reuses Python workers."""
    key = (os.getpid(), path)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(path)
    return _ENCODERS[key]
