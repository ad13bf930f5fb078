"""Operator 11: alignment of the tokens of two tokenizers on the bytes of each text.

The method in short: character offsets of `tokenizers` and byte spans of sentencepiece's proto
are coarse cuts; where several tokens share a character (pieces of a multibyte character, bytes
of a fallback) the cut run is refined with the tokens' decoded bytes, and every run is compared
with the bytes of the text.

Both tokenizers cut a text from context before a space that follows a character other than a
space and precedes another one: the first one's pattern ends a word there, and the second one
has no piece with a space behind another character (both are looked up when they are loaded;
otherwise a whole text is one unit). So a text is aligned unit by unit, and a unit that a
worker has seen, such as a common word, is looked up instead of tokenised again.

One pass writes each text's figures and its linked id pairs with their numbers, beside the
task's own sums of pairs; these sums make the corpus-wide table of pairs, which is joined to
the texts' pairs, in blocks that are small enough to broadcast.

Defined cases: texts that are null, empty or not given back by the decoded bytes of either
tokenizer have no tokens: zeros and an empty groups_sha256; they count in no pair. Repeated
rows and rows without doc_id are rows of their own. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bounds on a worker's memory: units and characters that it keeps, bytes of text in a batch, pairs that it sums before it sends them on.
UNITS, UNIT_CHARS, BATCH_BYTES, PAIRS = 600_000, 16_000_000, 2_000_000, 1_000_000
#: Units that are tokenised as one text.
CHUNK = 2000
#: Rows of a block of the table of pairs: some 40 bytes each where they are broadcast.
BLOCK = 1_000_000

_CUT = re.compile(r"(?<=\S)(?= .)", re.S)
_ODD = re.compile(r"^ |\s | $")
_ROWS = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{}>, times array<int>"


def _byte_of() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Both tokenizers, their tokens' bytes, and the units aligned so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer, processors

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.post_processor = processors.ByteLevel(trim_offsets=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of, vocab = _byte_of(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        word_wise = self.a.normalizer is None and "ByteLevel" in repr(self.a.pre_tokenizer) and "use_regex=True" in repr(self.a.pre_tokenizer) and "add_prefix_space=False" in repr(self.a.pre_tokenizer)
        self.by_unit = word_wise and not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i))
        # Text of a token with what follows it in a group list: nothing, "," "|" or ";".
        self.a_said, self.b_said = (np.array([f"{i}{end}" for i in range(n) for end in ("", ",", "|", ";")], object) for n in (len(self.a_bytes), self.n_b))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.said: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)  # whole, n_a, n_b, n_groups, n_links
        self.first = np.zeros(1, np.int64)  # of a unit's links in ``links``
        self.links = np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def units(self, text: str) -> list[str]:
        """The units of space + text, each without its leading space."""
        if not self.by_unit:
            return [text]
        if _ODD.search(text):
            return [u[1:] for u in _CUT.split(" " + text)]
        return text.split(" ")

    def learn(self, units: list[str]) -> None:
        """Align units not seen before, many in one text: joined by spaces they are cut where they were cut before."""
        alone = [[u] for u in units if not u or u[-1].isspace()] if self.by_unit else [[u] for u in units]
        others = [u for u in units if u and not u[-1].isspace()] if self.by_unit else []
        chunks = [others[i : i + CHUNK] for i in range(0, len(others), CHUNK)] + alone
        while chunks:
            texts = [" ".join(c) for c in chunks]
            first, second = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, return_type="proto", num_threads=1)
            again = []
            for chunk, text, a, b in zip(chunks, texts, first, second, strict=True):
                whole = (" " + text).encode()
                end = np.cumsum([len(u.encode()) + 1 for u in chunk]) if len(whole) != len(text) + 1 else np.cumsum([len(u) + 1 for u in chunk])
                (ia, ea), (ib, eb) = self._first(text, whole, a), self._second(whole, b)
                if ea is not None and eb is not None and np.isin(end, ea).all() and np.isin(end, eb).all():
                    self._align(chunk, end, ia, ea, ib, eb)
                elif len(chunk) > 1:
                    again += [[u] for u in chunk]
                else:
                    self._add(chunk, [""], np.zeros((1, 5), np.int64), np.zeros(0, np.int64))
            chunks = again
        self._settle()

    def _align(self, units: list[str], end: np.ndarray, ia: np.ndarray, ea: np.ndarray, ib: np.ndarray, eb: np.ndarray) -> None:
        # Each stretch between two ends of either kind is one link; each end of both kinds closes a group.
        stretch, both = np.union1d(ea, eb), np.intersect1d(ea, eb, assume_unique=True)
        links = ia[np.searchsorted(ea, stretch)] * self.n_b + ib[np.searchsorted(eb, stretch)]
        count = lambda ends: np.diff(np.concatenate([[0], np.searchsorted(ends, end, "right")]))
        facts = np.stack([np.ones(len(units), np.int64), count(ea), count(eb), count(both), count(stretch)], 1)
        said = self._said(ia, ea, ib, eb, both, end)
        parts = np.concatenate([[0], np.cumsum(facts[:, 1] + facts[:, 2])]).tolist()
        self._add(units, ["".join(said[s:e]) for s, e in zip(parts[:-1], parts[1:], strict=True)], facts, links)

    def _add(self, units: list[str], said: list[str], facts: np.ndarray, links: np.ndarray) -> None:
        at = len(self.said)
        self.at.update(zip(units, range(at, at + len(units)), strict=True))
        self.said += said
        self.fresh.append((facts, links))
        self.chars += sum(map(len, units))

    def _settle(self) -> None:
        facts, links = zip(*self.fresh, strict=True)
        self.fresh = []
        facts = np.concatenate(facts)
        self.facts = np.concatenate([self.facts, facts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(facts[:, 4])])
        self.links = np.concatenate([self.links, *links])

    def _said(self, ia, ea, ib, eb, both, unit_end) -> list[str]:
        """Ids with their separators, in the order of the groups: first a group's tokens of the one kind, then those of the other."""
        if not len(both):
            return []
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        a_before, b_before = np.concatenate([[0], np.searchsorted(ea, both, "right")]), np.concatenate([[0], np.searchsorted(eb, both, "right")])
        last = np.isin(both, unit_end)
        a_end = np.where(ea == both[ga], 2, 1)
        b_end = np.where(eb == both[gb], np.where(last[gb], 0, 3), 1)
        out = np.empty(len(ia) + len(ib), object)
        out[np.arange(len(ia)) + b_before[ga]] = self.a_said[ia * 4 + a_end]
        out[np.arange(len(ib)) + a_before[gb + 1]] = self.b_said[ib * 4 + b_end]
        return out.tolist()

    def _first(self, text: str, whole: bytes, made) -> tuple[np.ndarray, np.ndarray | None]:
        ids = made.ids
        spans = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if len(whole) != len(text) + 1:  # from characters to bytes
            code = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
            spans = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])[spans]
        return np.array(ids, np.int64), refined(whole, spans[:, 0], spans[:, 1], list(map(self.a_bytes.__getitem__, ids)))

    def _second(self, whole: bytes, made) -> tuple[np.ndarray, np.ndarray | None]:
        told = np.fromiter(chain.from_iterable((p.id, p.begin, p.end) for p in made.pieces), np.int64).reshape(-1, 3)
        start, end = told[:, 1] + 1, told[:, 2] + 1
        start[:1] = 0  # the space in front is the tokenizer's own
        return told[:, 0], refined(whole, start, end, list(map(self.b_bytes.__getitem__, told[:, 0].tolist())))


def refined(text: bytes, start: np.ndarray, end: np.ndarray, decoded: list[bytes]) -> np.ndarray | None:
    """Byte ends of tokens from coarse cuts (byte spans) and decoded bytes; None where the bytes are not those of the text.

    A token whose span the next one follows is cut at its span's end. Tokens whose spans overlap,
    or that have an empty one, form a run with what follows, cut by the decoded bytes.
    """
    if not len(decoded) or b"".join(decoded) != text:
        return None
    cut = np.ones(len(decoded), bool)
    cut[:-1] = (start[1:] == end[:-1]) & (end[:-1] > start[:-1])
    sizes = np.fromiter(map(len, decoded), np.int64, len(decoded))
    ends = np.where(cut, end, 0)
    if not cut.all():
        by_bytes = np.cumsum(sizes)
        run = np.concatenate([[0], np.cumsum(cut)[:-1]])  # of each token
        before = np.concatenate([[0], ends[cut][:-1]])  # where its run starts
        first = np.concatenate([[True], cut[:-1]])
        ends = np.where(cut, end, before[run] + by_bytes - (by_bytes - sizes)[first][run])
    return ends if ends[-1] == len(text) and (np.diff(ends, prepend=0) == sizes).all() else None


_LOADED: dict[tuple[str, str], Tokens] = {}


def _tokens(a_path: str, b_path: str) -> Tokens:
    if (a_path, b_path) not in _LOADED:
        _LOADED.clear()
        _LOADED[a_path, b_path] = Tokens(a_path, b_path)
    return _LOADED[a_path, b_path]


def _batched(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Pieces of a batch of bounded bytes; a longer text is a piece of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_BYTES or i + 1 == len(texts):
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0


def figures(tokens: Tokens, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """For each text: n_a, n_b, n_groups, n_links, groups_sha256, its different pairs and their numbers."""
    split = [tokens.units(t) if t and "▁" not in t else None for t in texts]
    every = set(chain.from_iterable(units for units in split if units))
    fresh = [u for u in every if u not in tokens.at]
    if len(tokens.at) + len(fresh) > UNITS or tokens.chars > UNIT_CHARS:
        tokens.forget()
        fresh = list(every)
    if fresh:
        tokens.learn(fresh)
    nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    for units in split:
        if units is None:
            yield nothing
            continue
        own = list(map(tokens.at.__getitem__, units))
        each = np.array(own, np.int64)
        sums = tokens.facts[each].sum(0)
        if sums[0] < len(own):
            yield nothing
            continue
        digest = hashlib.sha256(";".join([tokens.said[i] for i in own]).encode()).hexdigest()
        kinds, often = np.unique(each, return_counts=True)
        n = tokens.facts[kinds, 4]
        where = np.repeat(tokens.first[kinds] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pairs, back = np.unique(tokens.links[where], return_inverse=True)
        times = np.bincount(back, np.repeat(often, n), len(pairs)).astype(np.int64)
        yield int(sums[1]), int(sums[2]), int(sums[3]), int(sums[4]), digest, pairs, times


def _lists(rows: list[np.ndarray], dtype) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(flat.astype(dtype)))


def _record(kind: int, rows: list, ids: list, made: list, pair) -> pa.RecordBatch:
    n, numbers = len(made), lambda k: pa.array([m[k] for m in made], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *[numbers(k) for k in range(4)], pa.array([m[4] for m in made], pa.string()), _lists([m[5] for m in made], pair), _lists([m[6] for m in made], np.int32)],
        names=[c.split()[0] for c in _ROWS.split(", ")],
    )


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    n_best counts the links whose pair is its second id's most frequent one, count_sum adds up
    how often each link's pair is linked in the whole corpus.
    """

    sizes = _vocabularies(a_path, b_path)
    n_b = sizes[1]
    pair = np.int32 if sizes[0] * n_b < 1 << 31 else np.int64  # of a pair of ids as one number
    schema = _ROWS.format("int" if pair is np.int32 else "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, row = _tokens(a_path, b_path), TaskContext.get().partitionId() << 33
        pairs, times, pending = [], [], 0

        def sent() -> pa.RecordBatch:
            """The task's sums so far."""
            kinds, back = np.unique(np.concatenate(pairs), return_inverse=True)
            return _record(1, [None], [None], [(0, 0, 0, 0, "", kinds, np.bincount(back, np.concatenate(times), len(kinds)).astype(np.int64))], pair)

        for batch in batches:
            for ids, texts in _batched(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                made = list(figures(tokens, texts))
                yield _record(0, list(range(row, row + len(ids))), ids, made, pair)
                row += len(ids)
                pairs += [m[5] for m in made]
                times += [m[6] for m in made]
                pending += sum(len(m[5]) for m in made)
                if pending > 4 * PAIRS:
                    full = sent()
                    if len(full["pairs"].flatten()) > PAIRS:
                        yield full
                        pairs, times, pending = [], [], 0
                    else:
                        pairs, times = [full["pairs"].flatten().to_numpy().astype(np.int64)], [full["times"].flatten().to_numpy()]
                        pending = len(pairs[0])
        if pending:
            yield sent()

    made = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(read, schema), "aligned")
    each = lambda rows, *more: rows.select(*more, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*more, F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = each(made.filter("kind = 1")).groupBy("pair").agg(F.sum(F.col("n").cast("long")).alias("count"))
    counts = written(counts, "pairs")
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of the second vocabulary
    judged = counts.withColumn("b", F.col("pair") % n_b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    rows = made.filter("kind = 0")
    linked, sums = each(rows, "row"), None
    size = counts.count()
    blocks = max(1, -(-size // BLOCK))
    for k in range(blocks):
        table = judged if blocks == 1 else judged.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)
        own = linked.join(F.broadcast(table), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
        sums = own if sums is None else sums.unionByName(own)
    if blocks > 1:
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _vocabularies(a_path: str, b_path: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(a_path).get_vocab_size(with_added_tokens=True), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
