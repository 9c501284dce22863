"""Byte-pair encoding and decoding with a pair occurrence index.

A partition's texts are read some million characters at a time; of each such part the distinct pieces (after normalising
and splitting) that the partition hasn't met before are laid out in one array of symbols.  An index maps each pair's
rank to all its positions there; a heap holds the active ranks.  The lowest active rank is applied at
all its positions, and only the lists of the pairs at their borders are updated.  If a merge makes a pair of a still
lower rank, the rest of that piece waits until the lower rank has been applied, so that each piece sees the merges in
the order the reference library applies them: by rank, then from left to right.

Supports vocabulary files of the tokenizers library with a BPE model, a ``</w>`` word end and no decoder, such as
``word_bpe_49k.json``.  The library's own normaliser and splitter prepare the pieces; the merges and the decoding are
done here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Texts of these characters only are split here: their lower-casing is plain, their composed form is their own, and
#: letters, digits and white space are told apart by the classes below.  All other texts take the library's path.
_PLAIN = re.compile(r"[\x01-\x7fÀ-ÖØ-öø-ÿ]*")
_PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]




def _is_plain(spec: dict) -> bool:
    """True if the file normalises and splits as the two patterns above do on plain texts."""
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"] == {"Regex": pattern}
        and split[0]["invert"]
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
    )


#: Pieces kept per Python worker with their ids; a full store is emptied, so results don't depend on it.
PIECES_KEPT = 400_000


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary without decoder, prefix and byte fallback is needed")
        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_ids = set(self.special.values())
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        #: (left id, right id), packed: rank
        self.merges: dict[int, int] = {}
        self.rank_pairs: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges[a << 32 | b] = rank
            self.rank_pairs.append((a, b, ab))
        # The ranks of pairs of single symbols, as a table: what an unmerged piece begins with.
        single = sorted(i for t, i in self.ids.items() if len(t.removesuffix(self.end) if self.end else t) <= 1)
        self._first_place = np.zeros(max(self.ids.values()) + 1, np.int32)
        self._first_place[single] = np.arange(len(single))
        self._first_ranks = np.full((len(single), len(single)), -1, np.int32)
        known = set(single)
        for pair, rank in self.merges.items():
            a, b = pair >> 32, pair & 0xFFFFFFFF
            if a in known and b in known:
                self._first_ranks[self._first_place[a], self._first_place[b]] = rank
        self._plain = _is_plain(spec)
        self._chars = _byte_chars()
        #: by piece as the text has it (plain texts), and by piece in byte characters (others, marked by a leading NUL)
        self._known: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str | int]:
        """The split pieces in order; an int is a special token's id."""
        if self._plain and _PLAIN.fullmatch(text) and "<|" not in text:
            return _PLAIN_PIECE.findall(text.lower())
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._by_library(text[at : m.start()]) if m.start() > at else []
            out.append(self.special[m[0]])
            at = m.end()
        if at < len(text):
            out += self._by_library(text[at:])
        return out

    def _by_library(self, text: str) -> list[str]:
        return ["\0" + p for p, _ in self._split(self._normalize(text))]

    def byte_piece(self, piece: str) -> str:
        """A piece in byte characters, as the merges know it."""
        if piece[0] == "\0":
            return piece[1:]
        chars = self._chars
        return piece if piece.isascii() and piece.isprintable() else "".join([chars[b] for b in piece.encode()])

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Each piece's ids, by the occurrence index over all of them."""
        ids, rank_of, end, push = self.ids, self.merges.get, self.end, heapq.heappush
        symbols: list[int] = []
        starts = [0]
        for piece in pieces:
            # A symbol that isn't in the vocabulary is left out, as no unknown token is defined.
            symbols += [ids[c] for c in piece[:-1] if c in ids]
            last = piece[-1:] + end
            if piece and last in ids:
                symbols.append(ids[last])
            starts.append(len(symbols))
        n = len(symbols)
        owner = np.repeat(np.arange(len(pieces)), np.diff(starts)).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts[:-1]:
            if s < n:
                before[s] = -1
        for e in starts[1:]:
            if e:
                after[e - 1] = -1
        where = self._index(symbols, starts)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = where.pop(rank, None)
            if places is None:
                continue
            left, right, merged = self.rank_pairs[rank]
            waiting: set[int] = set()
            rest: list[int] = []
            places.sort()
            for i in places:
                j = after[i]
                if symbols[i] != left or j < 0 or symbols[j] != right:
                    continue
                if waiting and owner[i] in waiting:
                    rest.append(i)
                    continue
                symbols[i], symbols[j] = merged, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    new = rank_of(merged << 32 | symbols[k])
                    if new is not None:
                        if new in where:
                            where[new].append(i)
                        else:
                            where[new] = [i]
                            push(active, new)
                        if new < rank:
                            waiting.add(owner[i])
                h = before[i]
                if h >= 0:
                    new = rank_of(symbols[h] << 32 | merged)
                    if new is not None:
                        if new in where:
                            where[new].append(h)
                        else:
                            where[new] = [h]
                            push(active, new)
                        if new < rank:
                            waiting.add(owner[i])
            if rest:  # they go on with this rank once the lower one has been applied
                where.setdefault(rank, []).extend(rest)
                push(active, rank)
        left_over = [[x for x in symbols[a:b] if x >= 0] for a, b in zip(starts, starts[1:])]
        return [tuple(x) for x in left_over]

    def _index(self, symbols: list[int], starts: list[int]) -> dict[int, list[int]]:
        """By rank, the positions of all pairs that can be merged."""
        if len(symbols) < 2:
            return {}
        s = np.array(symbols, np.int64)
        ranks = self._first_ranks[self._first_place[s[:-1]], self._first_place[s[1:]]]
        border = np.array(starts[1:-1], np.int64)
        ranks[border[(border > 0) & (border < len(s))] - 1] = -1  # no pair across two pieces
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        ranks = ranks[at]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        if not len(first):
            return {}
        places = at.tolist()
        return {r: places[a:b] for r, a, b in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(places)], strict=True)}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.pieces(t) for t in texts]
        known = self._known
        every = set(chain.from_iterable(split))
        special = every & self._special_ids
        every -= special
        new = list(every.difference(known))
        if len(known) + len(new) > PIECES_KEPT:
            known.clear()
            new = list(every)
        known.update(zip(new, self.encode_pieces([self.byte_piece(p) for p in new]), strict=True))
        ids_of = known.__getitem__
        if special:
            own = {p: (p,) for p in special}
            ids_of = lambda p: own[p] if p.__class__ is int else known[p]
        return [list(chain.from_iterable(map(ids_of, s))) for s in split]

    def forget(self) -> None:
        """Drops the store and gives its memory back to the system."""
        self._known.clear()
        give_back()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder the library joins the tokens, special ones included, with spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str, batch_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row; a null text counts as empty and has no ids.

    ``vocabulary`` names the file by its name in the installed package ``public_tokenizers`` or by a path that every
    executor can read.  Rows that share a doc_id are encoded each on their own; texts of any length are encoded whole, some
    million characters at a time between texts; other columns are ignored.
    """

    def run(batches):
        bpe = load(resolve(vocabulary))
        for batch in batches:
            ids, texts = batch.column(0), [t.as_py() or "" for t in batch.column(1)]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= batch_chars):
                    chars += len(texts[to])
                    to += 1
                encoded = bpe.encode_batch(texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(encoded, pa.list_(pa.int32())), pa.array([bpe.decode(e) for e in encoded], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )
                at = to
        bpe.forget()  # the worker goes on to other tasks

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def resolve(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of encoded rows (doc_id, ids, decoded)."""
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def reference_digest(ids: list[int], decoded: str) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
