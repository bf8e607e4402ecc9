"""Byte-pair encoding and decoding with batched numpy merge rounds.

Texts are cut at white space, which no word spans; what stands between is looked up
whole, and cut into words only where it has not been seen before. The words that are new
lie in one flat array of symbol ids. A round takes each word's lowest rank and merges all
its places at once; ranks come from a binary search over the sorted pair keys, for all
pairs at first and then for those that a merge has changed. The rounds end when no word
has a pair left. Texts are then put together from what was looked up.

A very long word would need a round over all of it for every rank in it, so its rounds
look only at the places of the rank that is next: symbols are linked, places wait by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tabulith.llm.common import map_arrow, strings

#: Most words that a Python worker remembers, half of them as last used before the other half began.
CACHED = 300_000
#: Characters of a word whose rounds look only at the places that they merge, and of the longest word that is remembered.
LONG, REMEMBERED = 500, 64
#: Characters of text handled at once.
CHUNK = 2_000_000
_FAR_WHITE = "\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WHITE = f"\\t-\\r {_FAR_WHITE}"
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC, white space to one space, lower case; words cut
    by a pattern; bytes as letters; byte-pair merges with a suffix at a word's end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, norm = spec["model"], spec["normalizer"]["normalizers"]
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        ordinary = (
            model["type"] == "BPE"
            and [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
            and norm[1]["pattern"] == {"Regex": "\\s+"}
            and norm[1]["content"] == " "
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and (letters["type"], letters["add_prefix_space"], letters["use_regex"]) == ("ByteLevel", False, False)
            and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and spec["decoder"] is None
            and spec["post_processor"] is None
        )
        if not ordinary:
            raise ValueError("a tokenizer file of another kind")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", _WHITE))
        self.white = regex.compile(f"[{_FAR_WHITE}]")
        alphabet = _byte_letters()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("two merges make one symbol; rounds could differ from single merges")
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # a merge comes after those that make its two symbols, so no merge brings up a lower rank than its own
        rank_of = {vocab[a + b]: rank for rank, (a, b) in enumerate(merges)}
        if any(max(rank_of.get(vocab[a], -1), rank_of.get(vocab[b], -1)) >= rank for rank, (a, b) in enumerate(merges)):
            raise ValueError("a merge comes before its parts; rounds could differ from single merges")
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens of another kind")
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.decimals = list(map(str, range(len(self.names))))
        #: Ids, and decoded text, of what has been seen, and of what was seen before that; no tuples, which the garbage collector would visit.
        self.known: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}
        #: Special tokens as texts show them, and nothing, which is all that an empty text has.
        self.marks = {t.upper(): t for t in special}
        if any(t.upper() == t.lower() or t.split() != [t] for t in special):
            raise ValueError("a special token that can't be told from text")

    def normalise(self, text: str) -> str:
        """Lower case, with no white space but that of ASCII where it can be elsewhere."""
        if not text.isascii():
            # character by character: a capital sigma at a word's end has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.white.search(text):
                text = self.white.sub(" ", text)
        return text.lower()

    def prepare(self, text: str) -> str:
        """The normalised text; special tokens stand in upper case, as nothing else does, between spaces."""
        if any(s in text for s in self.special):
            text = " ".join(part.upper() if k % 2 else self.normalise(part) for k, part in enumerate(self.cut.split(text)))
        else:
            text = self.normalise(text)
        return text.strip(" \t\n\v\f\r")

    def merge(self, words: list[str]) -> tuple[list[str], list[str]]:
        """The ids of each word, and its symbols, joined by spaces."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        ids = self.inner[flat]
        ids[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        # the rank of each symbol with the one after it
        rank = np.append(self._ranks(ids[:-1], ids[1:]), _NONE)
        rank[ends - 1] = _NONE
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[starts, len(ids)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), counts)
            live = lowest != _NONE
            if not live.all():
                done_ids.append(ids[~live])
                done_owner.append(owner[~live])
                ids, owner, rank, lowest = ids[live], owner[live], rank[live], lowest[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == lowest)
            if (follows := np.diff(at) == 1).any():
                # in a run of overlapping places every second one is taken, from the left
                first = np.maximum.accumulate(np.where(np.r_[True, ~follows], np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made[rank[at]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, owner, rank = ids[stays], owner[stays], rank[stays]
            at -= np.arange(len(at))
            changed = np.r_[at - (at > 0), at]
            after = np.minimum(changed + 1, len(ids) - 1)
            rank[changed] = np.where((owner[changed] == owner[after]) & (changed < after), self._ranks(ids[changed], ids[after]), _NONE)
        all_ids, all_owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(all_owner, kind="stable")
        bounds = np.searchsorted(all_owner[order], np.arange(len(raw) + 1)).tolist()
        found = all_ids[order].tolist()
        decimals, names = list(map(self.decimals.__getitem__, found)), list(map(self.names.__getitem__, found))
        return [" ".join(decimals[i:j]) for i, j in zip(bounds, bounds[1:])], [" ".join(names[i:j]) for i, j in zip(bounds, bounds[1:])]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair of symbols, _NONE where they don't merge."""
        pair = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[place] == pair, self.ranks[place], _NONE)

    def merge_long(self, word: str) -> list[int]:
        """The ids of one word, in time that grows with its merges and not with their rounds."""
        flat = np.frombuffer(word.encode("utf-8"), np.uint8)
        n = len(flat)
        # symbol by place, -1 where it has gone into the one before; the place after the last is a symbol that merges with none
        ids = np.r_[self.inner[flat[:-1]], self.final[flat[-1:]], 0]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        waiting: dict[int, list[np.ndarray]] = {}
        next_ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            ranks = self._ranks(ids[places], ids[after[places]])
            ranks[after[places] == n] = _NONE
            order = np.argsort(ranks, kind="stable")
            order = order[: np.searchsorted(ranks[order], _NONE)]
            found = ranks[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else []
            for rank, part in zip(found[starts].tolist(), np.split(places[order], starts[1:])) if len(found) else ():
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(next_ranks, rank)
                waiting[rank].append(part)

        wait(np.arange(n - 1))
        while next_ranks:
            rank = heapq.heappop(next_ranks)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[ids[at] >= 0]
            at = at[after[at] < n]
            at = at[self._ranks(ids[at], ids[after[at]]) == rank]
            if len(at) > 1 and (follows := after[at[:-1]] == at[1:]).any():
                # in a run of overlapping places every second one is taken, from the left
                first = np.maximum.accumulate(np.where(np.r_[True, ~follows], np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at], ids[gone] = self.made[rank], -1
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            wait(np.unique(np.r_[at, left[left >= 0]]))
        return ids[:n][ids[:n] >= 0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ``ids`` joined by spaces: these files name no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def _recall(self, runs: set[str]) -> None:
        """Takes out of ``runs`` what is known, or was."""
        runs.difference_update(self.known)
        known, shown = self.older
        for run in runs.intersection(known):
            self.known[run], self.shown[run] = known[run], shown[run]
            runs.remove(run)

    def _learn(self, runs: set[str]) -> list[str]:
        """Makes all runs known; those of them, and of their words, that are too long to be remembered."""
        cut: list[tuple[str, list[str]]] = []
        words: set[str] = set()
        self._recall(runs)
        for run in runs:
            if run.isascii() and run.isalpha():
                words.add(run)
            elif run in self.marks:
                self.known[run], self.shown[run] = str(self.special[self.marks[run]]), self.marks[run]
            else:
                cut.append((run, self.words.findall(run)))
                words.update(cut[-1][1])
        self._recall(words)
        short = [w for w in words if len(w) <= LONG]
        if short:
            ids, decoded = self.merge(short)
            self.known.update(zip(short, ids))
            self.shown.update(zip(short, decoded))
        for word in words:
            if len(word) > LONG:
                found = self.merge_long(word)
                self.known[word], self.shown[word] = " ".join(map(self.decimals.__getitem__, found)), self.decode(found)
        for run, parts in cut:
            if len(parts) != 1:
                self.known[run], self.shown[run] = " ".join(map(self.known.__getitem__, parts)), " ".join(map(self.shown.__getitem__, parts))
        return [p for p in words.union(runs) if len(p) > REMEMBERED]

    def encode_columns(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each text: the number of ids, the ids as decimals joined by spaces, the decoded text."""
        if 2 * len(self.known) > CACHED:
            self.known, self.shown, self.older = {}, {}, (self.known, self.shown)
        whole = pa.array(list(map(self.prepare, texts)), pa.large_string())
        # a mark after a letter, at a run's end, is a word of its own in any case: so "end," needs no look of its own
        whole = pc.replace_substring_regex(whole, r"([a-z])([.,;:!?])([ \t-\r]|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(whole)
        runs = split.values.dictionary_encode()
        distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = self._learn(set(distinct))
        found = [list(map(of.__getitem__, distinct)) for of in (self.known, self.shown)]
        for run in long:
            del self.known[run], self.shown[run]
        ids, decoded = (
            pc.binary_join(type(split).from_arrays(split.offsets, pa.array(x, pa.large_string()).take(runs.indices)), pa.scalar(" ", pa.large_string())) for x in found
        )
        return pc.if_else(pc.equal(ids, ""), 0, pc.add(pc.count_substring(ids, " "), 1)).cast(pa.int64()), ids, decoded

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """encode_columns() by text."""
        return zip(*(column.to_pylist() for column in self.encode_columns(texts)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.encode_batch([text]))[1].split()]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each file in a worker."""
    return WordBpe(path)


def chunks(texts: Iterable[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Consecutive texts, together of about ``most`` characters or one text."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def ids_of(counts: pa.Array, ids: pa.Array) -> pa.Array:
    """Ids as encode_columns() gives them, as lists of numbers."""
    ends = np.cumsum(np.r_[0, counts.to_numpy()])
    values = pc.split_pattern(ids, " ").values
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.filter(pc.not_equal(values, "")).cast(pa.int32()))


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of ids and decoded text of every row, and with
    ``with_ids`` the ids (array<int>) and the decoded text themselves.

    Reads ``doc_id`` and ``text``, whatever else is there. Null and empty texts have no
    ids and decode to an empty text. Repeated rows are encoded each. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            at = 0
            for texts in chunks(strings(batch.column("text"))):
                counts, ids, decoded = bpe.encode_columns(texts)
                columns = [
                    batch.column("doc_id").slice(at, len(texts)),
                    counts,
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids.cast(pa.large_binary()).to_pylist()], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded.cast(pa.large_binary()).to_pylist()], pa.string()),
                ]
                if with_ids:
                    columns += [ids_of(counts, ids), decoded.cast(pa.string())]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return map_arrow(docs.select("doc_id", "text"), run, schema)
