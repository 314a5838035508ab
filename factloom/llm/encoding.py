"""Encoding of whole texts with the tokenizers library.

A tokenizer that splits at white space gives the same ids for a text as for
its parts, when it is cut before a single space between two characters that
are not white space. Texts are cut there, each new distinct part is encoded
once and kept for later texts, and the texts' ids are gathered from the
parts'. What is kept is bounded by MOST_PARTS; beyond it, the half that was
met most often stays. A text that holds a special token is encoded in one piece.
"""

from __future__ import annotations

import os
import re
import sys
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut is safe before such a space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space, as Unicode and Python have it, for the pattern of texts with a space beside white space or with any at an end.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A full stop or comma between a letter and white space is a word of its own; elsewhere it may be part of a longer one.
JOINED_STOP = r"[^\pL\x09-\x0d\x20][.,][\x20\n]|\x{130}"
ODD_SPACE = rf"{SPACE} | {SPACE}|\A{SPACE}|{SPACE}\z"


def release() -> None:
    """Lets go of the encoders that this Python worker, which is used again for other work, has kept."""
    sys.__dict__.pop("_factloom_encoders", None)


def _taken(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids from begins to ends, one part after the other, and where each part's begin and end there."""
    lengths = ends - begins
    found = [ids[:0]]
    # A stretch of parts at a time, so that what stands between fits in a cache.
    for i in range(0, len(lengths), 1 << 15):
        n = lengths[i : i + (1 << 15)]
        steps = np.repeat(begins[i : i + (1 << 15)] - (np.cumsum(n) - n), n)
        steps += np.arange(len(steps))
        found.append(ids[steps])
    stops = np.cumsum(lengths)
    return np.concatenate(found), stops - lengths, stops


class TextEncoder:
    """Encodes batches of texts; end_id closes every text.

    spaced: whether ids of a part cover the space before it (byte-level
    tokenizers), or the last id of every word is one that ends words.
    """

    #: Characters of text that are encoded at once, and of joined new parts in a string.
    BATCH, BLOCK = 4 << 20, 1_000
    #: Distinct parts whose ids are kept, and characters of the longest that is.
    MOST_PARTS, LONGEST_PART = 450_000, 64

    def __init__(self, path: str, end_id: int, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], dtype="<u4")
        self.spaced = spaced
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of text under each id, or whether it ends a word.
        self.measure = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.measure[i] = len(token) if spaced else token.endswith("</w>")
        #: Kept parts, in the order of their numbers: all their ids, where each one's begin and end, and how often it was met.
        self.places: dict[str, int] = {}
        self.kept_ids, self.kept_begins, self.kept_ends, self.met = self.end[:0], *(np.zeros(0, dtype=np.int64) for _ in range(3))

    @classmethod
    def of_process(cls, path: str, end_id: int, spaced: bool) -> TextEncoder:
        """One encoder for all tasks that a Python worker runs, kept with the interpreter: functions are pickled by value."""
        kept = sys.__dict__.setdefault("_factloom_encoders", {})
        key = (path, end_id, spaced)
        if key not in kept:
            kept[key] = cls(path, end_id, spaced)
        return kept[key]

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _sizes(self, parts: list[str]) -> np.ndarray:
        """What the ids of each part measure in sum; 0 if that is not certain."""
        texts = pa.array(parts, pa.large_string())
        if self.spaced:
            return pc.binary_length(texts).to_numpy() + 1
        # Letters are one word; so is a full stop or comma after them. The lower case of one letter is not a letter only.
        plain = pc.invert(pc.match_substring(texts, "\u0130"))
        word = pc.and_(plain, pc.utf8_is_alpha(texts))
        stem = pc.utf8_slice_codeunits(texts, 0, -1)
        closed = pc.and_(plain, pc.and_(pc.utf8_is_alpha(stem), pc.match_substring_regex(texts, r"[.,]\z")))
        return np.where(np.asarray(word), 1, np.where(np.asarray(closed), 2, 0)).astype(np.int64)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct parts that neither begin nor end with white space, and where each part's begin and end."""
        sizes = self._sizes(parts)
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        sizes[lengths == 0] = -1
        order = np.argsort(np.where(sizes > 0, 0, np.where(sizes == 0, 1, 2)), kind="stable")
        sure, some = int((sizes > 0).sum()), int((sizes >= 0).sum())
        sizes, lead = sizes[order], " " if self.spaced else ""
        blocks = np.cumsum(lengths[order[:sure]] + 1) // self.BLOCK
        edges = np.flatnonzero(np.diff(blocks, prepend=-1)).tolist() + [sure]
        sorted_parts = [parts[i] for i in order.tolist()]
        texts = [lead + " ".join(sorted_parts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found: list[np.ndarray] = []
        stops: list[np.ndarray] = []
        base = 0
        for ids, a, b in zip(self._direct(texts), edges[:-1], edges[1:], strict=True):
            measured, wanted = np.cumsum(self.measure[ids]), np.cumsum(sizes[a:b])
            cut = np.searchsorted(measured, wanted)
            if not len(ids) or cut[-1] != len(ids) - 1 or (measured[cut] != wanted).any():
                one_by_one = self._direct([lead + p for p in sorted_parts[a:b]])
                ids, cut = np.concatenate(one_by_one), np.cumsum([len(x) for x in one_by_one]) - 1
            found.append(ids)
            stops.append(base + cut + 1)
            base += len(ids)
        single = self._direct([lead + p for p in sorted_parts[sure:some]])
        stops += [base + np.cumsum([len(x) for x in single], dtype=np.int64)]
        stop = np.concatenate(stops)
        stop = np.concatenate([stop, np.full(len(parts) - some, stop[-1] if len(stop) else 0, dtype=np.int64)])
        begins, ends = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        begins[order], ends[order] = np.concatenate([[0], stop[:-1]]) if len(parts) else stop, stop
        return np.concatenate([*found, *single, self.end[:0]]), begins, ends

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like _encode_parts, but only what is new is encoded."""
        at = np.fromiter(map(self.places.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        is_new = at < 0
        known = at[~is_new]
        self.met[known] += 1
        new = list(compress(parts, is_new.tolist()))
        ids, begins, ends = self._encode_parts(new)
        base = len(self.kept_ids)
        all_ids = np.concatenate([self.kept_ids, ids])
        all_begins, all_ends = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        all_begins[~is_new], all_ends[~is_new] = self.kept_begins[known], self.kept_ends[known]
        all_begins[is_new], all_ends[is_new] = base + begins, base + ends
        self._keep(new, ids, begins, ends)
        return all_ids, all_begins, all_ends

    def _keep(self, parts: list[str], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Keeps new parts, but for long ones, and as many as there is room for once the less frequent of the kept have gone."""
        short = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) <= self.LONGEST_PART
        if len(self.places) + int(short.sum()) > self.MOST_PARTS:
            self._thin(self.MOST_PARTS // 2)
        short &= np.cumsum(short) <= self.MOST_PARTS - len(self.places)
        if not short.all():
            parts = list(compress(parts, short.tolist()))
            ids, begins, ends = _taken(ids, begins[short], ends[short])
        first, base = len(self.places), len(self.kept_ids)
        self.places.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.kept_ids, self.met = np.concatenate([self.kept_ids, ids]), np.concatenate([self.met, np.zeros(len(parts), dtype=np.int64)])
        self.kept_begins, self.kept_ends = np.concatenate([self.kept_begins, begins + base]), np.concatenate([self.kept_ends, ends + base])

    def _thin(self, most: int) -> None:
        """Lets go of all but those kept parts that were met most often, later ones before earlier ones; old meetings count half."""
        stay = np.zeros(len(self.met), dtype=bool)
        stay[np.argsort(self.met, kind="stable")[max(0, len(self.met) - most) :]] = True
        self.places = {p: i for i, p in enumerate(compress(self.places, stay.tolist()))}
        self.kept_ids, self.kept_begins, self.kept_ends = _taken(self.kept_ids, self.kept_begins[stay], self.kept_ends[stay])
        self.met = self.met[stay] // 2

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text with the end id; a null text is empty."""
        out: list[np.ndarray] = []
        begin = size = 0
        for i, text in enumerate([*texts, None]):
            if i == len(texts) or size and size + len(text or "") > self.BATCH:
                out += self._encode([t or "" for t in texts[begin:i]])
                begin, size = i, 0
            size += len(text or "") + 1
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        whole = {i for i, t in enumerate(texts) if not t or any(s in t for s in self.special)}
        if not self.spaced:
            # White space of any length separates words and is dropped, and so is case.
            plain = pc.ascii_lower(pa.array(["" if i in whole else t for i, t in enumerate(texts)], pa.large_string()))
            cut = plain
            for stop in ", ", ". ", ",\n", ".\n":
                cut = pc.replace_substring(cut, stop, f" {stop}")
            lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(plain, JOINED_STOP), plain, cut))
            return self._gather(texts, lists, whole, {})
        return self._by_parts(texts)

    def _by_parts(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        whole = {i for i, t in enumerate(texts) if not t or any(s in t for s in self.special)}
        is_odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), ODD_SPACE).to_pylist()
        heads, tails, middles = [""] * len(texts), [""] * len(texts), list(texts)
        for i, text in enumerate(texts):
            if i in whole:
                middles[i] = ""
                continue
            odd = is_odd[i]
            # Parts at the ends of a text, with white space around or no space before, are encoded by themselves.
            if not odd:
                heads[i], _, middles[i] = text.partition(" ")
                continue
            cuts = [m.start() for m in SAFE_CUT.finditer(text)]
            if len(cuts) < 2:
                whole.add(i)
                middles[i] = ""
                continue
            heads[i], tails[i] = text[: cuts[0]], text[cuts[-1] :]
            middles[i] = text[cuts[0] + 1 : cuts[-1]]
        odd_middle = [i for i, m in enumerate(middles) if m and is_odd[i]]
        lists = pc.split_pattern(pa.array(middles, pa.large_string()), " ")
        if odd_middle:
            split = {i: SAFE_CUT.split(middles[i]) for i in odd_middle}
            lists = pa.array([split.get(i) or (m.split(" ")) for i, m in enumerate(middles)], pa.list_(pa.large_string()))
        ends_ = [i for i in range(len(texts)) if heads[i] or tails[i]]
        edges = self._direct(list(chain.from_iterable((heads[i], tails[i]) for i in ends_)))
        return self._gather(texts, lists, whole, {i: (edges[2 * k], edges[2 * k + 1]) for k, i in enumerate(ends_)})

    def _gather(self, texts: list[str], lists: pa.ListArray, whole: set[int], around: dict) -> list[np.ndarray]:
        """Ids of texts from those of their parts, of what stands around these, and of texts to encode whole."""
        counts = np.diff(lists.offsets.to_numpy())
        encoded = lists.values.dictionary_encode()
        values, part_begins, part_ends = self._parts(encoded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = encoded.indices.to_numpy()
        begins, lengths = part_begins[codes], (part_ends - part_begins)[codes]
        flat = _taken(values, begins, begins + lengths)[0]
        marks = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        pieces = dict(zip(whole, self._direct([texts[i] for i in whole]), strict=True)) if whole else {}
        out = []
        for i in range(len(texts)):
            if i in pieces:
                out.append(np.concatenate([pieces[i], self.end]))
                continue
            middle = flat[marks[i] : marks[i + 1]]
            before, after = around.get(i, (self.end[:0], self.end[:0]))
            out.append(np.concatenate([before, middle, after, self.end]).astype("<u4", copy=False))
        return out
