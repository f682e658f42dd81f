"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

1. Every whole text is tokenized; its ids and the separator are cut into pieces of at most `room` tokens. Per piece only
   its length and the checksum of its ids are kept (texts and ids never reach the plan). The result is written once.
2. The histogram of piece lengths has at most `room` rows. Best fit decreasing runs on it on the driver: the counts of
   a length go to the fullest open sequences that still hold it, whole groups of equal sequences at a time, so the
   work depends on the number of distinct lengths, not of documents. The plan says: ranks a..b of length l take the
   sequences s, s+1, ... at offset o.
3. Pieces get their rank within their length (evenly dealt, whatever the largest group of equal lengths) and take
   their slot by joining on length and rank.

With `window`, sequences follow the mix of sources: a window is so many consecutive blocks of `mixing.schedule`, each is
planned by itself from its own histogram, on the workers, and sequences are numbered window by window. So any run of
sequences has the sources' target shares to within a window, at the cost of at most a partly filled sequence or so in each.

Defined cases: null text is empty: a document of the separator alone; an empty table gives an empty result; repeated
rows are packed each; null ids are kept; a very long text has as many pieces as it needs; other columns, also ones such as
`piece` or `length`, are ignored; ties among equal lengths go by hash of the id.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefmesh.llm import mixing
from beliefmesh.llm.common import lean, materialise, pick, ranked, small_batches, worker_state
from beliefmesh.llm.tokens import WORD_PIECES, is_plain, load, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
ROOM = 4096
END = 1
CACHE = 250_000  # words whose ids a worker keeps


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; ids of plain words are kept by worker."""

    def __init__(self, path: str):
        state = worker_state(f"ids {path}")
        if not state:
            state["tokenizer"], state["words"] = load(path), {}
            vocabulary = state["tokenizer"].get_vocab()
            state["closing"] = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a word
            state["closing"][[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.tokenizer, self.words, self.closing, self.pieces = state["tokenizer"], state["words"], state["closing"], re.compile(WORD_PIECES).findall

    def learn(self, words: list[str], step: int = 200) -> None:
        known = self.words
        groups = [words[i : i + step] for i in range(0, len(words), step)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = ((np.nonzero(self.closing[ids])[0] + 1) * 4).tolist()
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                known[w] = raw[start:end]
                start = end

    def of(self, texts: list[str | None]) -> list[bytes]:
        known = self.words
        if len(known) > CACHE:  # what came first is the most frequent; nothing is dropped between the two look-ups
            for w in list(known)[CACHE // 2 :]:
                del known[w]
        split = [self.pieces(t.lower()) if t and is_plain(t) else None for t in texts]
        new = set().union(*[set(s).difference(known) for s in split if s])
        if new:
            self.learn(list(new))
        out = []
        for t, s in zip(texts, split, strict=True):
            if s is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b"")
            else:
                out.append(b"".join(map(known.__getitem__, s)))
        return out


def pieces_of(docs: DataFrame, path: str, room: int, end: int, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the `carry` columns (names and types)."""
    carry = carry or {}
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.iloc[at : at + 256]
                rows = []
                more = [b[c].tolist() for c in carry]
                for doc, got, *own in zip(b["doc_id"].tolist(), ids.of(b["text"].tolist()), *more, strict=True):
                    got += last
                    for k, i in enumerate(range(0, len(got), 4 * room)):
                        cut = got[i : i + 4 * room]
                        rows.append((doc, k, i // 4, len(cut) // 4, zlib.crc32(cut), *own))
                frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *carry])
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    small_batches(docs.sparkSession)
    more = "".join(f", {c} {kind}" for c, kind in carry.items())
    return pick(docs, "doc_id", "text", *carry).mapInPandas(lean(run, f"ids {path}"), f"doc_id long, piece int, start long, length long, ids_crc32 long{more}")


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts. Rows (length, rank from, rank to, first sequence, offset)."""
    rows: list[tuple[int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, count)
    sizes: list[int] = []  # room left, ascending, of groups that are open
    following = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                per = room // length
                full, rest = divmod(left, per)
                for count, each in ((full, per), (1 if rest else 0, rest)):
                    if count:
                        for k in range(each):
                            rows.append((length, rank, rank + count, following, k * length))
                            rank += count
                        add(open_by_room, sizes, room - each * length, following, count)
                        following += count
                left = 0
                continue
            space = sizes[at]
            first, count = open_by_room[space].pop()
            if not open_by_room[space]:
                del open_by_room[space], sizes[at]
            took = min(count, left)
            rows.append((length, rank, rank + took, first, room - space))
            rank, left = rank + took, left - took
            add(open_by_room, sizes, space - length, first, took)
            if took < count:
                add(open_by_room, sizes, space, first + took, count - took)
    return rows


def add(open_by_room: dict, sizes: list[int], space: int, first: int, count: int) -> None:
    if space:
        if space not in open_by_room:
            open_by_room[space] = []
            bisect.insort(sizes, space)
        open_by_room[space].append((first, count))


PLACE = "doc_id, piece, start, length, ids_crc32, slot.first + rank - slot.a as sequence_id, slot.offset as offset"


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END, splits: int = 256, window: int | None = None, **mix) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. window: blocks of the mix of sources that
    are packed together (default: all documents together, whatever their source); mix: options of mixing.schedule."""
    path = path or vocabulary_path(VOCABULARY)
    tie = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    if window is not None:
        return pack_windows(docs, path, room, end, window, tie, mix)
    pieces = materialise(pieces_of(docs, path, room, end))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list] = {}
    for length, a, b, first, offset in plan(histogram, room):
        by_length.setdefault(length, []).append((a, b, first, offset))
    spark = docs.sparkSession
    slots = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()], "__g long, slots array<struct<a:long,b:long,first:long,offset:long>>")
    placed = ranked(pieces, F.col("length"), tie, "rank", splits, slots)
    return placed.withColumn("slot", slot_of()).selectExpr(*PLACE.split(", "))


def slot_of():
    """The row of the plan that a rank falls in."""
    return F.expr("filter(slots, s -> s.a <= rank and rank < s.b)[0]")


def pack_windows(docs: DataFrame, path: str, room: int, end: int, window: int, tie: list, mix: dict) -> DataFrame:
    own = pick(docs, "doc_id", "source", "text").withColumns({mixing.TIE: mixing.tie_of(), "__row": F.monotonically_increasing_id()})
    # numbered as it is written, so that a document's pieces find its window
    pieces = materialise(pieces_of(own, path, room, end, {"source": "string", mixing.TIE: "long", "__row": "long"}))
    turns = mixing.schedule(pieces.where("piece = 0"), carry=["__row"], tie=[mixing.TIE], **mix).select("__row", F.expr(f"turn div {window}").alias("__w"))
    pieces = materialise(pieces.join(turns, "__row").select("doc_id", "piece", "start", "length", "ids_crc32", "__w"))

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        """One window's histogram, at most `room` rows."""
        got = plan(dict(zip(rows["length"].tolist(), rows["n"].tolist(), strict=True)), room)
        out = pd.DataFrame(got, columns=["length", "a", "b", "first", "offset"])
        return out.assign(__w=rows["__w"].iloc[0], used=int((out["first"] + out["b"] - out["a"]).max()))

    histogram = pieces.groupBy("__w", "length").agg(F.count(F.lit(1)).alias("n"))
    plans = materialise(histogram.groupBy("__w").applyInPandas(planned, "length long, a long, b long, first long, offset long, __w long, used long"))
    # a row a window, at most MOST_BLOCKS / window of them: where its sequences begin
    before = Window.orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
    begins = plans.groupBy("__w").agg(F.max("used").alias("used")).select("__w", F.coalesce(F.sum("used").over(before), F.lit(0)).alias("begin"))
    at = plans.join(begins, "__w").withColumn("first", F.col("first") + F.col("begin"))
    group = lambda: F.struct(F.col("__w"), F.col("length"))
    slots = at.groupBy(group().alias("__g")).agg(F.sort_array(F.collect_list(F.struct("a", "b", "first", "offset"))).alias("slots"))
    placed = ranked(pieces, group(), tie, "rank", 16, slots)
    return placed.withColumn("slot", slot_of()).selectExpr(*PLACE.split(", "))
