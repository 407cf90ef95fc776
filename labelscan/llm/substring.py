"""Removal of repeated passages through FM-indexes of shards.

A window is WINDOW consecutive words of one document. It is to go if its words also start in a document of smaller id.

1. Anchors. Each window has an anchor, its GRAM-word run of smallest hash. Equal windows have equal anchors at equal
   places, and neighbouring windows mostly share theirs, so there is an anchor for some 18 words. An anchor's piece is
   the stretch of words that all windows with this anchor lie in.
2. Pieces that agree are one, of the smallest id that holds them (its owner). Anchors whose run occurs in one document
   only are dropped. This is all counting, with partial sums.
3. Shards. Pieces of the same run go to the same shard, of a bounded number of words, over which an FM-index is built;
   the shard's pieces are streamed through it by backward search over its wavelet matrix, and every position whose
   matching statistic reaches the window reports the smallest owner in its interval.
4. A run with more than HOT different pieces (a passage in many surroundings) has each piece halved: the windows that
   begin further before the anchor, and the others. The words that all windows of a half have in common are a longer run
   than before, halves of one run meet again, equal ones are one again, and runs that are still hot are halved further,
   down to single windows. No shard depends on how common a run is, and what only one document holds drops out at once.
5. Each occurrence of a piece takes the windows whose owner is smaller than its own id, and documents drop what these
   cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.fm_index import FMIndex
from labelscan.llm.shared import Words, bucketed, mixed, pieces, plus, powers, runs, stored

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM  # words by which a window may begin before its anchor
#: Different pieces of a run that one shard takes (its index is some 60 MB), and words up to which runs share one. The
#: results depend on neither.
HOT, SHARD_WORDS = 8192, 200_000


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each n consecutive values."""
    done = 1
    while done * 2 <= n:
        x, done = f(x[:-done], x[done:]), done * 2
    return f(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """(document, word within it, run's hash, piece's hash, piece's first and end word) of each anchor; words count from the batch's first."""
    n = len(words.hashes)
    if n < WINDOW:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    docs = words.docs
    grams = runs(words.hashes, GRAM)
    least = _slide(grams, REACH + 1, np.minimum)
    least[docs[: n - WINDOW + 1] != docs[WINDOW - 1 :]] = 0  # no window of one document starts here
    padded = np.zeros(len(grams) + REACH, np.uint64)
    padded[REACH : REACH + len(least)] = least
    at = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == grams)
    d = docs[at]
    first, end = np.maximum(at - REACH, words.first[d]), np.minimum(at + WINDOW, words.first[d + 1])
    return d, at - words.first[d], grams[at], _spans(words, first, end) ^ mixed((at - first).astype(np.uint64)), first, end


def _spans(words: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(words.hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes * up[:-1], dtype=np.uint64)))
    return mixed((sums[end] - sums[first]) * down[first])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                d, _, key, piece, first, _ = anchors(words := Words(part.column("text")))
                start = pa.array((first - words.first[d]).astype(np.int32))
                own = [part.column(c).take(pa.array(d)) for c in ("slot", "mark")]
                columns = [*own, start, pa.array(key.view(np.int64)), pa.array(piece.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "mark", "start", "key", "piece"])

    return docs.mapInArrow(run, "slot long, mark int, start int, key long, piece long")


ASKED = "array<struct<key: long, piece: long, mark: int, at: int, low: int, high: int, last: long>>"


def _asked(part: pa.RecordBatch, words: Words) -> dict[str, np.ndarray]:
    """The units that each document of a batch is asked for, with their owner, document, and anchor as a word of the batch.

    `low` and `high` bound by how many words a unit's windows begin before the anchor. Without an anchor (at < 0) a unit
    is a piece, which is looked for by its hash. Units of another text of a repeated id are left out.
    """
    asked = part.column("wanted")
    base = np.asarray(asked.offsets)
    lists = asked.values.slice(base[0], base[-1] - base[0])
    out = {c: lists.field(c).to_numpy(zero_copy_only=False) for c in ("key", "piece", "low", "high", "last")}
    place, mark = (lists.field(c).to_numpy(zero_copy_only=False) for c in ("at", "mark"))
    out["doc"] = doc = np.repeat(np.arange(words.n), np.diff(base))
    out["owner"] = part.column("slot").to_numpy()[doc]
    at = np.where(place >= 0, place + words.first[doc], -1)
    at[mark != part.column("mark").to_numpy()[doc]] = -1
    if (place < 0).any():
        d, within, key, piece, _, _ = anchors(words)
        have = np.column_stack((d, key.view(np.int64), piece.view(np.int64)))
        rows, found = np.unique(have, axis=0, return_index=True)
        both = np.concatenate((rows, np.column_stack((doc, out["key"], out["piece"]))))
        _, inverse = np.unique(both, axis=0, return_inverse=True)
        first = np.full(int(inverse.max(initial=-1)) + 1, -1)
        first[inverse[: len(rows)]] = found
        hit = first[inverse[len(rows) :]]
        at = np.where(hit >= 0, within[hit] + words.first[doc], -1) if len(within) else np.full(len(doc), -1)
    out["at"] = at
    return {c: x[at >= 0] for c, x in out.items()}


def _span(words: Words, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of a unit within its document; a unit without a window ends before WINDOW words."""
    low = np.maximum(low, at + WINDOW - words.first[doc + 1])
    high = np.minimum(high, at - words.first[doc])
    return at - high, at - low + WINDOW


def _texts(owned: DataFrame) -> DataFrame:
    """Words of the asked units: (shard, unit, owner, words); a unit's shard is its run and it has one owner."""
    names = ["shard", "unit", "owner", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"))
                u = _asked(part, words)
                first, end = _span(words, u["doc"], u["at"], u["low"], u["high"])
                raw, bounds = words.data, zip(words.starts[first].tolist(), words.ends[end - 1].tolist(), strict=True)
                columns = [pa.array(u[c], pa.int64()) for c in ("key", "piece", "owner")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([raw[a:b].tobytes() for a, b in bounds], pa.binary())], names)

    return owned.mapInArrow(run, "shard long, unit long, owner long, words binary")


def _halves(owned: DataFrame) -> DataFrame:
    """Both halves of the asked units: `n` windows of (up_key, up_piece), those that begin further before the anchor being `early`."""
    ints = ["mark", "at", "low", "high", "n"]
    longs = ["up_key", "up_piece", "key", "piece", "owner", "last"]
    schema = ", ".join([f"{c} long" for c in longs] + [f"{c} int" for c in ints] + ["early boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column("text"))
                u = _asked(part, words)
                middle = (u["low"] + u["high"]) // 2
                u = {c: np.concatenate((x, x)) for c, x in u.items()}
                early = np.arange(len(u["at"])) < len(middle)
                low = np.where(early, np.tile(middle + 1, 2), u["low"])
                high = np.where(early, u["high"], np.tile(middle, 2))
                first, end = _span(words, u["doc"], u["at"], low, high)
                n = end - first - WINDOW + 1
                has = np.flatnonzero((n > 0) & (low <= high))
                at, doc, low, high, first, end = (x[has] for x in (u["at"], u["doc"], low, high, first, end))
                key = _spans(words, at - low, at + WINDOW - high) ^ mixed((low * 64 + high + 1).astype(np.uint64))
                piece = _spans(words, first, end) ^ mixed((at - first).astype(np.uint64))
                columns = {"up_key": u["key"][has], "up_piece": u["piece"][has], "key": key.view(np.int64), "piece": piece.view(np.int64)}
                columns |= {c: u[c][has] for c in ("owner", "last")}
                marks = part.column("mark").to_numpy()[doc]
                columns |= {"mark": marks, "at": at - words.first[doc], "low": low, "high": high, "n": n[has]}
                arrays = [pa.array(columns[c], pa.int64()) for c in longs] + [pa.array(columns[c].astype(np.int32)) for c in ints]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(early[has])], [*longs, *ints, "early"])

    return owned.mapInArrow(run, schema)


def _shared(units: DataFrame) -> DataFrame:
    """Those units (key, piece, owner, last, ...) whose run several documents hold, with `hot` for the runs of many units.

    The runs are written first: joined from there, and not from the aggregate, the units of a hot run can be split.
    """
    by_run = units.groupBy("key").agg(F.min("owner").alias("_low"), F.max("last").alias("_high"), F.count(F.lit(1)).alias("_n"))
    return units.join(stored(by_run.where("_low < _high").select("key", (F.col("_n") > HOT).alias("hot")), "runs"), "key")


def search(units: DataFrame) -> DataFrame:
    """Distinct units (shard, unit, owner, words) -> (shard, unit, owners): the smallest owner of each window of a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def index(table: pa.Table) -> pa.RecordBatch:
            words = Words(table.column("words").combine_chunks().cast(pa.string()))
            found = FMIndex(words.hashes, words.counts, table.column("owner").to_numpy(), WINDOW).owners()
            n = np.maximum(words.counts - WINDOW + 1, 0)
            flat = found[np.arange(found.shape[1]) < n[:, None]]
            owners = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([table.column("shard").combine_chunks(), table.column("unit").combine_chunks(), owners], ["shard", "unit", "owners"])

        for batch in batches:
            # rows come ordered by shard; what may go on in the next batch is held back
            while batch.num_rows:
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column("words"))).as_py() // 6
                batch = batch.slice(0, 0)
            if size >= SHARD_WORDS:
                table = pa.Table.from_batches(held)
                shards = table.column("shard").to_numpy()
                words = np.cumsum(pc.binary_length(table.column("words")).to_numpy()) // 6
                cut = 0
                for target in range(SHARD_WORDS, int(words[-1]) + 1, SHARD_WORDS):
                    at = int(np.searchsorted(words, target))
                    same = np.flatnonzero(shards[at:] != shards[min(at, len(shards) - 1)])
                    if not len(same):
                        break
                    if at + int(same[0]) > cut:
                        yield index(table.slice(cut, at + int(same[0]) - cut))
                        cut = at + int(same[0])
                held = table.slice(cut).combine_chunks().to_batches() if cut < len(shards) else []
                size = sum(pc.sum(pc.binary_length(b.column("words"))).as_py() // 6 for b in held)
        if held:
            yield index(pa.Table.from_batches(held))

    ordered = units.select("shard", "unit", "owner", "words").repartition("shard").sortWithinPartitions("shard")
    return ordered.mapInArrow(run, "shard long, unit long, owners array<long>")


def repeats(docs: DataFrame) -> DataFrame:
    """(slot, mark, text), bucketed by slot -> (slot, spans): windows that start in a document of smaller slot.

    A span is (mark of the text, first word of a piece, bits of its windows). Only hashes and the wanted pieces' words are shuffled: the
    texts stay in their buckets.
    """
    rows = _anchor_rows(docs)
    distinct = stored(rows.groupBy("key", "piece").agg(F.min("slot").alias("owner"), F.max("slot").alias("last")), "pieces")
    nowhere = [F.lit(x).cast("int").alias(c) for c, x in (("mark", 0), ("at", -1), ("low", 0), ("high", REACH))]
    wanted = stored(_shared(distinct).select("*", *nowhere), "wanted")

    def owned(hot: bool) -> DataFrame:
        unit = F.struct("key", "piece", "mark", "at", "low", "high", "last")
        asked = wanted.where(F.col("hot") == hot).groupBy("owner").agg(F.collect_list(unit).cast(ASKED).alias("wanted"))
        return docs.join(asked, F.col("slot") == F.col("owner")).select("slot", "mark", "text", "wanted")

    named = {"shard": "key", "unit": "piece"}
    levels = []
    while True:  # at most six times: a piece has REACH + 1 windows
        found = search(_texts(owned(False))).withColumnsRenamed(named)
        if wanted.where("hot").isEmpty():
            break
        halves = stored(_halves(owned(True)), "halves")
        levels.append((stored(found, "owners"), halves))
        place = F.min(F.struct("owner", "mark", "at"))
        units = halves.groupBy("key", "piece").agg(place.alias("_p"), *[F.max(c).alias(c) for c in ("last", "low", "high")])
        wanted = stored(_shared(units.select("key", "piece", "_p.*", "last", "low", "high")), "wanted")
    for whole, halves in reversed(levels):
        owners = F.coalesce("owners", F.array_repeat("owner", F.col("n")))  # else no other document holds its windows
        parts = halves.join(found, ["key", "piece"], "left").select("up_key", "up_piece", F.struct(~F.col("early"), owners.alias("owners")).alias("x"))
        joined = parts.groupBy("up_key", "up_piece").agg(F.array_sort(F.collect_set("x")).alias("x"))
        found = whole.union(joined.select("up_key", "up_piece", F.flatten("x.owners")))
    found = stored(found, "owners")
    met = rows.join(found, ["key", "piece"])
    bit = lambda o, i: F.when(o < F.col("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.aggregate(F.transform("owners", bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    hit = met.select("slot", F.struct("mark", "start", bits.alias("bits")).alias("span")).where("span.bits <> 0")
    return hit.groupBy("slot").agg(F.collect_set("span").alias("spans"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus n_words, n_removed, removed (spans of words, end exclusive) and kept_text (the kept words, joined by a space).

    Windows are judged on the input. Null, empty and blank texts and those of fewer than WINDOW words lose nothing; a null
    text's kept_text is empty. Rows without an id neither lose nor take words. Rows that repeat an id don't take words
    from each other. An empty table gives no rows; columns of docs with a result's name are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "removed", "kept_text")
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = plain[docs.columns.index(text)]
    ids = F.col(plain[docs.columns.index(key)]).cast("long")
    # rows without an id are spread by their texts, and take no part in the search
    slots = docs.toDF(*plain).withColumn("has_id", ids.isNotNull()).withColumn("slot", F.coalesce(ids, F.xxhash64(at)))
    kept = bucketed(slots, "slot", "texts")
    found = repeats(kept.where("has_id").select("slot", F.hash(at).alias("mark"), F.col(at).alias("text")))
    found = found.withColumnRenamed("slot", "_slot")
    joined = kept.join(found, (F.col("slot") == F.col("_slot")) & F.col("has_id"), "left")
    joined = joined.select(*plain, F.filter("spans", lambda s: s["mark"] == F.hash(at)).alias("spans"))
    schema = plus(docs, "n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                words = Words(part.column(at), hashes=False)
                gone = np.zeros(len(words.starts) + 1, np.int64)
                spans = part.column("spans")
                has = np.flatnonzero(pc.is_valid(spans).to_numpy(zero_copy_only=False))
                for d in has.tolist():
                    own = spans[d].values
                    start = own.field("start").to_numpy().astype(np.int64)
                    bits = own.field("bits").to_numpy()
                    row, bit = np.nonzero((bits[:, None] >> np.arange(REACH + 1)) & 1)
                    first = np.unique(start[row] + bit) + words.first[d]
                    gone[first] += 1
                    gone[first + WINDOW] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                removed = np.diff(np.concatenate(([0], np.cumsum(covered)))[words.first])
                texts, lists = [], []
                for d in range(words.n):
                    own = words.words(d)
                    if removed[d]:
                        mask = covered[words.first[d] : words.first[d + 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
                        lists.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                        own = [w for w, m in zip(own, mask.tolist(), strict=True) if not m]
                    else:
                        lists.append([])
                    texts.append(b" ".join(own).decode())
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                counts = [pa.array(x.astype(np.int64)) for x in (words.counts, removed)]
                columns = [*counts, pa.array(lists, spans_type), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), *columns], names)

    return joined.mapInArrow(run, schema)
