"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a state machine.

A merge can only be undone or made by what stands to its right through a chain of merges of ever higher priority. Going
through the merge list once, in order, gives for each merge how far such a chain can reach; the most of these, and the
longest token, is the lookahead after which a token is settled. The transducer merges a window of a piece, emits the tokens
that end before its last `lookahead` bytes and moves on, so pieces of any length take constant memory. Pieces that were
met before come from a bounded memory.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, table

#: Words that are remembered, by digests and (next to other operators' memories) by encoders, and the longest of them in characters; bytes that are merged at once, in lookaheads.
REMEMBERED, FEWER, LONGEST, WINDOW = 400_000, 80_000, 64, 4
NONE = 1 << 62
#: Unicode's White_Space, which the tokenizer's \s stands for; Python's own notion has four more.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = re.compile(f"[{WHITE}]+")
_MORE = re.compile("[\x1c-\x1f]")
#: Ids that a decoder is fed at once.
FED = 65_536
#: Code points that may be assigned one day or are: the others are noncharacters, surrogates or for private use.
POINTS = (*range(0x80, 0xD800), *range(0xF900, 0x40000), *range(0xE0000, 0xE1000))


@lru_cache(4)
def differences(path: str) -> tuple[tuple[str, str, str], ...]:
    """(character, kind, lower case) where the tokenizers library's Unicode tables say other than Python's or the pattern
    engine's: kind is L, N or O for a letter, a digit or another, as the file's pattern cuts them. The library is asked once
    for each code point: what a letter is by the pieces that it makes, lower case and composition by its normalizers.

    A character whose composition or place among combining marks differs is listed too, whatever its kind."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        pattern = next(p for p in json.load(f)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    split, lower, nfc = pre_tokenizers.Split(Regex(pattern), "removed", invert=True), normalizers.Lowercase(), normalizers.NFC()
    own, out = regex.compile(pattern), []

    def kinds(chars: str, pieces) -> list[str]:
        """By the pieces of "ac" and "!c" for every c: those that c joins."""
        joined = []
        for start in "a!":
            at = dict(pieces(" ".join(start + c for c in chars)))
            joined.append([at.get(3 * i) == 2 for i in range(len(chars))])
        return ["L" if a else "O" if b else "N" for a, b in zip(*joined, strict=True)]

    for points in batched(POINTS, 8192):
        chars = "".join(map(chr, points))
        theirs = kinds(chars, lambda s: [(a, b - a) for _, (a, b) in split.pre_tokenize_str(s)])
        ours = kinds(chars, lambda s: [(m.start(), m.end() - m.start()) for m in own.finditer(s)])
        tests = [[f"{before}{c}{after}" for c in chars] for before, after in (("", ""), ("a", "\u0334"), ("a\u0345", ""))]
        bulk = [(nfc.normalize_str("\n".join(t)).split("\n"), [unicodedata.normalize("NFC", x) for x in t]) for t in tests]
        lowered = lower.normalize_str("\n".join(chars)).split("\n")
        for i, c in enumerate(chars):
            if c in WHITE:
                continue
            if theirs[i] != ours[i] or lowered[i] != c.lower() or any(a[i] != b[i] for a, b in bulk):
                out.append((c, theirs[i], lowered[i]))
    return tuple(out)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and special tokens of a byte-level word tokenizer's file: NFC, lower case, a pattern for pieces."""

    def __init__(self, path: str, differ: tuple | None = None, remembered: int = REMEMBERED):
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        differ = differences(path) if differ is None else differ
        self._differ = frozenset(c for c, *_ in differ)
        self._beyond = re.compile(f"[{min(self._differ)}-\U0010ffff]") if differ else re.compile("(?!)")
        self._stand = {ord(c): {"L": "a", "N": "1", "O": "!"}[kind] for c, kind, _ in differ}
        self._lower = {c: low for c, _, low in differ}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.plain = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.byte = {c: b for b, c in enumerate(letters)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model.pop("merges"))
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.rank = {a << 32 | b: r for (a, b), (r, _) in self.merges.items()}
        self.made = [t for _, t in self.merges.values()]
        self.length = {i: len(t.removesuffix(self.end)) if t not in ("", self.end) else len(t) for t, i in self.vocab.items()}
        self.lookahead = self._lookahead()
        self.known: dict[str, tuple[str, int]] = {}
        self.pieces: dict[str, list[int]] = {}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        let_go()  # what reading the file took

    @cached_property
    def named(self) -> dict[str, str]:
        """What decoders look up by the digits of an id; encoders don't need it."""
        return {str(i): t for t, i in (self.vocab | self.special).items()}

    @cached_property
    def raw(self) -> dict[str, bytes]:
        return {i: self._raw(t) for i, t in self.named.items()}

    def _lookahead(self) -> int:
        """How many bytes after a token can have a say in it: the reach of the furthest merge, plus the longest token,
        plus one to see whether the piece ends."""
        made: dict[int, int] = defaultdict(int)  # by token: bytes after it that decide whether it forms
        taken: dict[int, int] = defaultdict(int)  # by token: the same for merges so far that take it away to the right
        for (a, b), (_, t) in self.merges.items():
            reach = max(made[b], taken[b], made[a] - self.length[b])
            made[t] = max(made[t], reach)
            taken[a] = max(taken[a], self.length[b] + max(reach, made[b]))
        return max([0, *made.values(), *taken.values()]) + max(self.length.values()) + 1

    def merged(self, ids: list[int]) -> list[int]:
        """All merges, lowest rank first and leftmost among equals."""
        merges = self.merges
        if len(ids) <= 64:
            rank, made = self.rank.get, self.made
            ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks:
                r = min(ranks)
                if r == NONE:
                    break
                i = ranks.index(r)
                t = ids[i] = made[r]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank(ids[i - 1] << 32 | t, NONE)
                if i < len(ranks):
                    ranks[i] = rank(t << 32 | ids[i + 1], NONE)
            return ids
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := (ids[x], ids[after[x]])) in merges:
                    heapq.heappush(heap, (merges[p][0], x, p))
        return [x for x in ids if x >= 0]

    def transduce(self, piece: bytes) -> Iterator[int]:
        """Tokens of one piece of any length, each emitted once no later byte can change it."""
        at, size = 0, WINDOW * self.lookahead
        while len(piece) - at > size:
            ids = self.merged([self.plain[b] for b in piece[at:at + size]])
            settled = at + size - self.lookahead
            for t in ids:
                if at + self.length[t] > settled:
                    break
                at += self.length[t]
                yield t
        yield from self.merged([*(self.plain[b] for b in piece[at:-1]), self.last[piece[-1]]])

    def word(self, word: str) -> tuple[str, int]:
        """Of a word without white space, in lower case: its ids, joined by a space, and their number."""
        ids: list[int] = []
        for p in [word] if word.isascii() and word.isalpha() else self.cut(word):
            ids += self.pieces.get(p) or self._piece(p)
        out = (" ".join(map(str, ids)), len(ids))
        if len(word) <= LONGEST:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[word] = out
        return out

    def differs(self, text: str) -> bool:
        """Whether a text has a character of which the library's tables say other than ours. Few texts have any as high."""
        return not text.isascii() and self._beyond.search(text) is not None and not self._differ.isdisjoint(text)

    def cut(self, word: str) -> list[str]:
        """The pieces of a word; where tables differ, the library's decide what is a letter or a digit."""
        if not self.differs(word):
            return self.piece.findall(word)
        return [word[m.start():m.end()] for m in self.piece.finditer(word.translate(self._stand))]

    def _piece(self, piece: str) -> list[int]:
        out = list(self.transduce(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= LONGEST:
            if len(self.pieces) >= self.remembered:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """What word() gives, for all words of a text; special tokens by themselves."""
        at = 0
        if self._special and "<|" in text:
            for m in self._special.finditer(text):
                yield from self._parts(text[at:m.start()])
                yield str(self.special[m.group()]), 1
                at = m.end()
        yield from self._parts(text[at:] if at else text)

    def _parts(self, text: str) -> Iterator[tuple[str, int]]:
        if self.differs(text):
            from tokenizers import normalizers

            text = normalizers.NFC().normalize_str(text)
            text = "".join([self._lower.get(c) or c.lower() for c in text])
        else:
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()  # each letter by itself: no final sigma
        get, new = self.known.get, self.word
        for w in _SPLIT.split(text) if _MORE.search(text) else text.split():
            if w:
                yield get(w) or new(w)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, n in self.parts(text or "") if n for i in ids.split(" ")]

    def _raw(self, token: str) -> bytes:
        """The bytes that a token stands for; the end of a word is a space, special tokens are their own text."""
        if token in self.special:
            return token.encode()
        ends = bool(self.end) and token.endswith(self.end) and token != self.end
        return bytes(self.byte[c] for c in (token.removesuffix(self.end) if ends else token)) + b" " * ends

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Turns ids into text run by run, in constant memory. Its state is whether a token came before, for the rule that the
    library follows where a file names no decoder (tokens as they are spelled, a space between them, special ones too; ids
    that aren't in the vocabulary give nothing), and at most three bytes of an unfinished character, for the text that the
    tokens' bytes spell; bytes that are no character become U+FFFD."""

    def __init__(self, tokenizer: Tokenizer):
        self.own, self.utf8, self.between = tokenizer, codecs.getincrementaldecoder("utf-8")("replace"), ""

    def feed(self, ids: Iterable[int | str]) -> tuple[str, str]:
        """What some more ids (numbers, or their digits) add: to the library's text, and to the text that bytes spell."""
        ids = ids if isinstance(ids, (list, tuple)) and ids and isinstance(ids[0], str) else [str(i) for i in ids]
        try:
            spelled, raw = " ".join(map(self.own.named.__getitem__, ids)), b"".join(map(self.own.raw.__getitem__, ids))
        except KeyError:
            ids = [i for i in ids if i in self.own.named]
            spelled, raw = " ".join(map(self.own.named.__getitem__, ids)), b"".join(map(self.own.raw.__getitem__, ids))
        out = self.between + spelled if spelled else ""
        if spelled:
            self.between = " "
        return out, self.utf8.decode(raw)

    def close(self) -> str:
        """What is left of an unfinished character."""
        out = self.utf8.decode(b"", True)
        self.utf8.reset()
        return out


@lru_cache(4)
def loaded(path: str, differ: tuple | None = None, remembered: int = REMEMBERED) -> Tokenizer:
    return Tokenizer(path, differ, remembered)


def encoded(df: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids: array of int) for each row; a null text counts as empty and has no ids. Rows are taken one by
    one, so repeated rows, ties and null idents stay as they are; other columns are left out, whatever their names."""
    differ = differences(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path, differ, FEWER)
        for b in batches:
            for at in range(0, len(b), 128):
                spelled = [" ".join([p[0] for p in own.parts(t or "") if p[1]]) for t in b.column(1).slice(at, 128).to_pylist()]
                ids = [np.fromstring(x, np.int32, sep=" ") if x else np.empty(0, np.int32) for x in spelled]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 128), pa.array(sizes), lists], names=["_id", "n_tokens", "ids"])
        own.known.clear()  # the worker lives on, with other stages' tasks
        own.pieces.clear()
        let_go()

    return df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(read, "_id long, n_tokens long, ids array<int>").withColumnRenamed("_id", ident)


def decoded(df: DataFrame, path: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(ident, text) from arrays of ids, by the incremental decoder; null ids give an empty text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path, ())
        for b in batches:
            texts = []
            for x in b.column(1):
                d = own.decoder()
                texts.append("".join([*(d.feed(run)[1] for run in batched(x.as_py() or (), FED)), d.close()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return df.select(F.col(ident).cast("long").alias("_id"), F.col(ids).alias("_ids")).mapInArrow(read, "_id long, text string").withColumnRenamed("_id", ident)


def digests(df: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_tokens, ids_sha256, decoded_sha256, text_sha256): digests of the transducer's ids, and of both texts that the
    decoder makes of them, the library's and the one that their bytes spell. A null text counts as empty; rows are taken
    one by one, and other columns are left out, whatever their names."""
    differ = differences(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path, differ)
        for b in batches:
            out = []
            for t in b.column(1):
                ids = " ".join([p[0] for p in own.parts(t.as_py() or "") if p[1]])
                decoder, digest, spelled = own.decoder(), hashlib.sha256(), hashlib.sha256()
                every = ids.split(" ") if ids else []
                for at in range(0, len(every), FED):
                    a, z = decoder.feed(every[at:at + FED] if len(every) > FED else every)
                    digest.update(a.encode())
                    spelled.update(z.encode())
                spelled.update(decoder.close().encode())
                out.append((len(every), hashlib.sha256(ids.encode()).hexdigest(), digest.hexdigest(), spelled.hexdigest()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.string() if i else pa.int64()) for i in range(4))], names=["_id", *names])

    kinds = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"
    return df.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(read, kinds).withColumnRenamed("_id", ident)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's tokens."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
