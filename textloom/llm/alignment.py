"""Cross-tokenizer alignment: groups of tokens between common byte ends, and how often token pairs are linked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.runtime import materialize, small_batches

#: Distinct segments that a worker keeps, and their ids; beyond either it begins anew after a block.
_SEGMENTS, _IDS = 400_000, 8 << 20
#: Bytes of text of a block of documents.
BLOCK = 2 << 20
#: Where white space outside ASCII may begin in UTF-8.
_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_SPACE, _BREAK = 32, 10


def _graphic() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that surely are no white space: as a character's first byte, and as a whole character."""
    whole = np.zeros(256, bool)
    whole[33:127] = True
    first = whole.copy()
    first[0xC3:0xF5] = True
    first[list(_LEADS)] = False
    return first, whole


_FIRST, _WHOLE = _graphic()


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Block:
    """Of a block's texts: token, group and link counts, digests, and slots into `pairs` with times, text k's from start[k] on."""

    sums: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    start: np.ndarray
    slots: np.ndarray
    times: np.ndarray


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of both sides, and the number of groups, by one merge of their cumulative ends.

    A stable sort of two ascending runs is their merge with one pointer into each; an end that comes
    twice in it is common to both sides and ends a group. The last ends must be equal.
    """
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")
    both = both[order]
    common = np.append(both[1:] == both[:-1], False)
    # the first of a common pair is A's, by stability; a token's group counts the common ends before its own
    group = np.empty(len(both), np.int64)
    group[order] = np.cumsum(common) - common
    group_b = group[len(ends_a) :]
    # B's token at a common end comes behind A's, where the group has been counted already
    last = np.zeros(len(both), bool)
    last[order[1:][common[:-1]]] = True
    return group[: len(ends_a)], group_b - last[len(ends_a) :], int(common.sum())


def spread(groups_a: np.ndarray, groups_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups, as places in A and in B, A's in order."""
    size_b = np.bincount(groups_b, minlength=n)
    first_b = np.cumsum(size_b) - size_b
    times = size_b[groups_a]
    at_a = np.repeat(np.arange(len(groups_a)), times)
    step = np.arange(len(at_a)) - np.repeat(np.cumsum(times) - times, times)
    return at_a, first_b[groups_a][at_a] + step


class Aligner:
    """Both tokenizers, and the ids of segments between places where each of them always cuts."""

    _kept: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in told["added_tokens"] if t["special"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        # ids ascend with the merges, so that they are ranks
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [told["model"]["vocab"]["".join(m)] for m in merges]
        if made != sorted(made) or told["normalizer"] is not None:
            raise ValueError(f"{path_a} is no byte-level BPE whose ids are in order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_a[list(ranks.values())] = [len(x) for x in ranks]
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # what an id is followed by in a group: another id of its side, the other side, or the next group
        self.named = [f"{i}{sign}".encode() for i in range(max(len(self.size_a), len(self.size_b))) for sign in ",|;"]
        # B cuts before a space mark that follows another character, and on both sides of a line break, if no piece spans them
        self.space_cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.mark = self.b.encode("\n")[:1]
        self.break_cuts = not any("\n" in p for p in pieces) and len(self.b.encode("\n")) == 2 and self.bytes_b[self.mark[0]] == b" "
        self.clear()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(path_a, path_b)
        return cls._kept[path_a, path_b]

    def clear(self) -> None:
        #: A segment's number; the ids of both sides one after the other, with the place of each segment's first; whether B spells it.
        self.index: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.start = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.spelt = np.zeros(0, bool)

    def segments(self, text: bytes) -> list[bytes]:
        """The text after a space, cut where both tokenizers cut whatever stands around: each piece begins with a space or a line break.

        A's pattern takes a space to the word behind it, and white space and other characters never share
        a match otherwise; so it cuts before a space that a character other than white space follows, and
        before a line break that such a character precedes.
        """
        text = b" " + text
        x = np.frombuffer(text, np.uint8)
        cut = np.zeros(len(x) + 1, bool)
        if self.space_cuts:
            cut[1 : len(x) - 1] = (x[1:-1] == _SPACE) & (x[:-2] != _SPACE) & _FIRST[x[2:]]
            if self.break_cuts:
                cut[1:-1] |= (x[1:] == _BREAK) & _WHOLE[x[:-1]]
        ends = [0, *np.flatnonzero(cut).tolist(), len(x)]
        return [text[i:j] for i, j in zip(ends, ends[1:])]

    def learn(self, segments: list[bytes]) -> None:
        """The ids of new segments."""
        if not segments:
            return
        texts = [x.decode() for x in segments]
        # B puts a space before what it is given: it stands for the segment's own, or goes again before a line break
        broken = np.array([x[0] == _BREAK for x in segments])
        b = [i or self.mark for i in self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)]
        a = [*map(self.a.encode_ordinary, texts)]
        flat, size = [], []
        for many in (a, b):
            size.append(np.fromiter(map(len, many), np.int64, len(many)))
            flat.append(np.fromiter(chain.from_iterable(many), np.int64, size[-1].sum()))
        first = np.cumsum(size[1]) - size[1]
        spelt = ~broken | (flat[1][first] == self.mark[0])
        flat[1] = np.delete(flat[1], first[broken])
        size[1] = size[1] - broken
        spelt &= np.diff(np.append(0, np.cumsum(self.size_b[flat[1]]))[np.append(0, np.cumsum(size[1]))]) == [*map(len, segments)]
        said = [self.bytes_b[i] for i in flat[1].tolist()]
        if b"".join(said) != b"".join(segments):
            ends = np.append(0, np.cumsum(size[1])).tolist()
            spelt &= [b"".join(said[i:j]) == x for i, j, x in zip(ends, ends[1:], segments, strict=False)]
        for x in segments:
            self.index[x] = len(self.index)
        for side in (0, 1):
            self.ids[side] = np.concatenate([self.ids[side], flat[side]])
            self.start[side] = np.append(self.start[side], self.start[side][-1] + np.cumsum(size[side]))
        self.spelt = np.append(self.spelt, spelt)

    def block(self, texts: list[bytes | None]) -> Block:
        if len(self.index) > _SEGMENTS or len(self.ids[0]) + len(self.ids[1]) > _IDS:
            self.clear()
        cut = [self.segments(t) if t else [] for t in texts]
        every = [*chain.from_iterable(cut)]
        self.learn([x for x in dict.fromkeys(every) if x not in self.index])
        number = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        of = np.repeat(np.arange(len(texts)), [*map(len, cut)])
        use = ~np.isin(of, of[~self.spelt[number]])
        number, of = number[use], of[use]
        both, sizes = [], []
        for ids, start in zip(self.ids, self.start, strict=True):
            n = start[number + 1] - start[number]
            both.append(ids[np.repeat(start[number] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            sizes.append(np.bincount(of, n, len(texts)).astype(np.int64))
        (a, b), (n_a, n_b) = both, sizes
        groups_a, groups_b, n = merge(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        # each text begins and ends with a group
        n_groups = np.diff(np.append(groups_a, n)[np.cumsum(n_a)], prepend=0) if len(a) else np.zeros(len(texts), np.int64)
        at_a, at_b = spread(groups_a, groups_b, n)
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        pairs, slots = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        key, times = np.unique(text_of_a[at_a] * max(1, len(pairs)) + slots, return_counts=True)
        n_links = np.bincount(text_of_a[at_a], minlength=len(texts))
        start = np.searchsorted(key, np.arange(len(texts) + 1) * max(1, len(pairs)))
        return Block(np.column_stack([n_a, n_b, n_groups, n_links]), self._digests(a, b, groups_a, groups_b, n_a + n_b), pairs, start, key % max(1, len(pairs)), times)

    def _digests(self, a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Of each text, with `sizes` ids of both sides: the digest of its groups written out."""
        out = np.empty(len(a) + len(b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True).astype(np.int64)
        out[np.arange(len(a)) + np.searchsorted(groups_b, groups_a)] = 3 * a + last(groups_a)
        out[np.arange(len(b)) + np.searchsorted(groups_a, groups_b, "right")] = 3 * b + 2 * last(groups_b)
        digests, at, get = [], 0, self.named.__getitem__
        for n in sizes.tolist():
            digests.append(hashlib.sha256(b"".join(map(get, out[at : at + n].tolist()))[:-1]).hexdigest() if n else "")
            at += n
        return digests


_DOCS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the merge emits, as a stored table, by blocks of about BLOCK bytes of text.

    Rows with a null slot are documents: their counts, digest, and the slots of the pairs they link, with
    how often. The others are a block's pairs: slot, a, b, and how many of its documents link them. A pair
    thus travels once per block and not once per document.
    """
    small_batches(docs, 256)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, block = Aligner.of(path_a, path_b), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        batches = (pa.RecordBatch.from_arrays([pa.array(f["id"]), pa.array(f["text"], pa.large_binary())], ["id", "text"]) for f in frames)
        for batch in K.chunks(batches, "text", BLOCK):
            got = aligner.block(batch.column(1).to_pylist())
            cut = lambda x: [x[i:j].astype("<u4").tobytes() for i, j in zip(got.start[:-1], got.start[1:], strict=True)]
            out = pd.DataFrame({"block": block, "slot": None, "id": batch.column(0).to_pylist(), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), got.sums.T, strict=True)), "groups_sha256": got.digests, "slots": cut(got.slots), "times": cut(got.times), "a": None, "b": None, "n": None})
            yield out
            if len(got.pairs):
                yield pd.DataFrame({"block": block, "slot": np.arange(len(got.pairs)), "id": None, "n_a": None, "n_b": None, "n_groups": None, "n_links": None, "groups_sha256": None, "slots": None, "times": None, "a": got.pairs >> 32, "b": got.pairs & 0xFFFFFFFF, "n": np.bincount(got.slots, minlength=len(got.pairs))})
            block += 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return materialize(rows.mapInPandas(run, f"block bigint, slot int, id {kind}, {_DOCS}, slots binary, times binary, a int, b int, n bigint"), "links")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best_a, best_b) of each linked id pair of links(): documents that hold it, and the most that a pair of its a and of its b has."""
    pairs = materialize(found.where("slot is not null").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = lambda side: pairs.groupBy(side).agg(F.max("n").alias(f"best_{side}"))
    return pairs.join(most("a"), "a").join(most("b"), "b").select("a", "b", "n", "best_a", "best_b")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b) of every row of docs.

    The tokens of both sides are cut into groups at the byte offsets where both end. Tokens of a group
    are linked, each of one side with each of the other. A pair's count is the number of documents (rows)
    that link it; n_best and n_best_b say how many of a row's links have the highest count of their a and
    of their b, ties included; count_sum adds the counts over all links.

    A null or empty text, and one whose bytes either tokenizer changes, has no tokens: zeros and an empty
    digest. Special tokens' strings are plain text. Rows with null or repeated ids each get their result;
    an empty table gives no rows; other columns are not read. A very long text is a block of its own.
    """
    found = links(docs, path_a, path_b, id_col, text_col)
    rated = found.where("slot is not null").select("block", "slot", "a", "b").join(pair_counts(found), ["a", "b"]).select(F.col("block").alias("of"), "slot", "n", (F.col("n") == F.col("best_a")).alias("top_a"), (F.col("n") == F.col("best_b")).alias("top_b"))
    kind = docs.schema[id_col].dataType.simpleString()

    def add(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values("slot")
        n, a, b = pairs["n"].to_numpy(np.int64), pairs["top_a"].to_numpy(np.int64), pairs["top_b"].to_numpy(np.int64)
        slots, times = (np.frombuffer(b"".join(rows[c]), "<u4").astype(np.int64) for c in ("slots", "times"))
        ends = np.cumsum(rows["slots"].map(len).to_numpy(np.int64) // 4)
        out = rows[["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
        for name, x in (("n_best", a), ("count_sum", n), ("n_best_b", b)):
            out[name] = np.diff(np.concatenate([[0], np.cumsum(x[slots] * times)])[ends], prepend=0)
        return out

    rows = found.where("slot is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times")
    out = rows.groupBy("block").cogroup(rated.groupBy("of")).applyInPandas(add, f"id {kind}, {_DOCS}, n_best bigint, count_sum bigint, n_best_b bigint")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b")
