"""Token counts by rank-synchronous array merging.

The vocabulary word_bpe_49k.json is read here and applied without the library: normal form C, white space, lower case by
character, pre-tokens, bytes; a file that asks for other steps is refused. Of a batch's texts, all pre-tokens that aren't known yet are
one ragged array of symbols; in each step every sequence applies its lowest-ranked pair at all its places at once, until no sequence
has a pair of the vocabulary; what survives is counted. Applying a pair at all places at once is the same as one by one from the
left, for a pair's rank exceeds those that make its parts; reading the vocabulary checks that.

Null text counts as empty and has no tokens. Strings of special tokens count as one token each, as the library has it. Texts
are read whole, however long; white space of ASCII never joins two tokens, so that counts of the pieces between add up. Those of
short pieces are kept for when they come again, in bounded memory. Ties and repeated rows don't matter; an empty table gives no rows;
only the id and the text are read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meshq.llm.common import worker_cache

#: Pieces of up to so many bytes are kept by a Python worker, in up to so many bytes; beyond, they are dealt with anew.
KEPT_LENGTH, KEPT_BYTES, ENTRY = 64, 160 << 20, 150
#: Bytes of text whose pieces are merged at once.
SLICE = 1 << 20
# The steps before the merges that this module takes.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """Byte-level BPE's character for each byte: itself if it is printable Latin-1, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def lower(text: str) -> str:
    """By character: a final sigma has no form of its own."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


def read_vocabulary(path: str) -> dict:
    """The file's content; one with other steps before the merges, or another kind of model, raises."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if spec.get("normalizer") != NORMALIZER or spec.get("pre_tokenizer") != PRE_TOKENIZER:
        raise ValueError(f"{path}: its normal form or pre-tokens aren't those that are built here")
    if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path}: no byte-pair model with word ends")
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
        raise ValueError(f"{path}: special tokens of another kind")
    return spec


class Bpe:
    def __init__(self, path: str) -> None:
        spec = read_vocabulary(path)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.space = regex.compile(f"[{SPACES}]+")
        self.pre = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        marks = byte_symbols()
        self.inner = np.array([vocab[c] for c in marks], np.int64)
        self.last = np.array([vocab[c + end] for c in marks], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        born = np.full(self.size, -1, np.int64)
        born[made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before what it merges; pairs can't be applied at once")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def pre_tokens(self, text: str) -> list[str]:
        return self.pre.findall(lower(self.space.sub(" ", unicodedata.normalize("NFC", text))))

    def merged_lengths(self, tokens: list[str]) -> np.ndarray:
        """The number of symbols of each pre-token after all merges."""
        raw = [t.encode("utf-8") for t in tokens]
        lens = np.array([len(r) for r in raw], np.int64)
        if not len(raw):
            return lens
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[data[ends]]
        seq = np.repeat(np.arange(len(raw)), lens)
        out = np.ones(len(raw), np.int64)
        while len(sym) > 1:
            rank = np.full(len(sym), NONE)
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            n = np.diff(np.r_[starts, len(sym)])
            done = least == NONE
            out[seq[starts[done]]] = n[done]
            goes = np.repeat(~done, n)
            if not goes.any():
                return out
            take = goes & (rank == np.repeat(least, n))
            # Of overlapping places of a pair like (a, a), every second one, from the left.
            p = np.flatnonzero(take)
            run = np.r_[True, np.diff(p) > 1]
            first = p[np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))]
            p = p[(p - first) % 2 == 0]
            sym[p] = self.made[rank[p]]
            keep = goes
            keep[p + 1] = False
            sym, seq = sym[keep], seq[keep]
        out[seq] = 1
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each text."""
        flat: dict[str, int] = {}
        spans = []
        extra = []
        for piece in pieces:
            parts = self.split.split(piece)
            extra.append(len(parts) // 2)
            spans.append([flat.setdefault(t, len(flat)) for part in parts[::2] if part for t in self.pre_tokens(part)])
        n = self.merged_lengths(list(flat)).tolist()
        return [e + sum(n[i] for i in s) for e, s in zip(extra, spans, strict=True)]


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. path: the vocabulary's file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or vocabulary_path())
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(1).cast(pa.binary())]
            n = np.array(count.of(texts), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


class Kept(dict):
    """What pieces of text were made into. Long pieces are dropped after their slice, and all when they fill their memory."""

    held = 0

    def take(self, made: dict) -> None:
        cost = sum(len(w) + ENTRY + (len(v) if isinstance(v, bytes) else 0) for w, v in made.items())
        if self.held + cost > KEPT_BYTES:
            self.clear()
            self.held = 0
        self.update(made)
        self.held += cost

    def drop_long(self, pieces) -> None:
        for w in pieces:
            if len(w) > KEPT_LENGTH and (v := self.pop(w, None)) is not None:
                self.held -= len(w) + ENTRY + (len(v) if isinstance(v, bytes) else 0)


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[list[bytes]]:
    """The texts in turn, as many at once as hold about that many bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


class Counter:
    """Tokens of UTF-8 texts; what is new in a slice of a batch is merged at once."""

    def __init__(self, path: str) -> None:
        self.bpe, self.known = Bpe(path), Kept()

    def of(self, texts: list[bytes]) -> list[int]:
        out = []
        for some in slices(texts):
            words = [t.split() for t in some]
            new = set().union(*words).difference(self.known)
            room = self.known.held
            if new:
                pieces = list(new)
                self.known.take(dict(zip(pieces, self.bpe.counts([w.decode("utf-8", "replace") for w in pieces]), strict=True)))
                if self.known.held < room:  # all that was kept has gone, and with it what this slice knew
                    pieces = list(set().union(*words).difference(self.known))
                    self.known.take(dict(zip(pieces, self.bpe.counts([w.decode("utf-8", "replace") for w in pieces]), strict=True)))
            out += [sum(map(self.known.__getitem__, w)) for w in words]
            self.known.drop_long(new)
        return out

    def __call__(self, text: bytes) -> int:
        return self.of([text])[0]


def counter(path: str) -> Counter:
    """One per Python worker, which Spark uses for task after task."""
    return worker_cache(f"counts {path}", lambda: Counter(path))
