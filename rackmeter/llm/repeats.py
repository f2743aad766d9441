"""Removal of byte strings that occur more than once in a corpus.

Every window of ``length`` bytes that starts in two places is removed wherever it is. Windows are dealt by
content: the least hash of the runs of ``anchor`` bytes in a window is its anchor, so equal windows share it, and
neighbouring windows of a text mostly do. A *run* of windows with one anchor is at most twice as long as a window.
Runs whose anchor is alone in the corpus hold no repeat. If all runs of an anchor are alike, all of their windows
repeat. The different runs of the other anchors are collections of short texts. What of them cannot hold a window of
another run, by the bytes next to the anchor, is left out; the rest is sorted:

Their collection Burrows-Wheeler transform is built column by column from the right. Each round extends the last
suffix of every text by one symbol; the place of the extended suffix follows from the symbols before it in the
transform, and the common prefixes next to it from the least ones between the extended suffixes' places. All
rounds read the transform and the prefixes in sequence and write them anew. These sequences belong to a block of
some hundred runs (about a hundred kilobytes), so they stay in the memory of the task and no file of a task has to
outlive it. The anchor counts as one symbol of its own, which keeps blocks with several anchors apart.

An anchor with very many different runs (a passage that a large share of documents holds) would make an
unbounded block. Its windows are counted one by one instead, by anchor and 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackmeter.llm.common import gram_hashes, lean, on_workers, span_hashes, stored, text_column, text_slices

LENGTH = 200
ANCHOR = 64
BLOCK_RUNS = 800
HOT_RUNS = 4096
#: Windows are told apart by how many bytes stand before the anchor, in bins of so many.
BIN = 8
#: Anchors with over 1 / SHARES of all rows of shared anchors are dealt to several tasks; there are fewer than SHARES.
SHARES = 1000
SIZE_BITS, MARK_BITS = 10, 22
#: Hashes are compared without as many low bits, which leaves room for the place (texts of 64 MB).
PLACE_BITS = 26


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first byte, end byte, hash of the anchor."""
    hashes = gram_hashes(data, anchor)
    width = length - anchor + 1
    if len(hashes) < width:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, hashes[:0]
    # leftmost least hash of every window; the place stands in the low bits
    bits = np.uint64(max(PLACE_BITS, len(hashes).bit_length()))
    least = sliding_minimum(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64), width)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.arange(len(place))
    doc = np.searchsorted(offsets, at, "right") - 1
    whole = at + length <= offsets[doc + 1]
    at, place, doc = at[whole], place[whole], doc[whole]
    fresh = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])] if len(at) else whole[:0]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(at)] - 1
    return doc[first], at[first], at[last] + length, hashes[place[first]]


def anchor_offsets(raws: list[bytes], length: int, anchor: int) -> np.ndarray:
    """Place of the anchor in each run."""
    hashes = gram_hashes(np.frombuffer(b"".join(raws), dtype=np.uint8), anchor)
    first = np.cumsum([0, *map(len, raws[:-1])])
    bits = np.uint64(PLACE_BITS)
    return np.argmin((hashes >> bits << bits)[first[:, None] + np.arange(length - anchor + 1)], axis=1)


def shared_bins(raws: list[bytes], groups: list[int], at: list[int], length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes that a window of each run may have before the anchor, if it is in another run.

    All windows of a bin hold the bytes that are common to the bin, so where no other run of the group has these
    bytes at its anchor, none of the windows occurs again. Runs without such a bin get a greatest number of -1.
    """
    spare = length - anchor
    low = np.full(len(raws), spare + 1)
    high = np.full(len(raws), -1)
    for least in range(0, spare + 1, BIN):
        most = min(least + BIN - 1, spare)
        behind = anchor + spare - most
        seen: dict[tuple[int, bytes], int] = {}
        for k, (raw, group, place) in enumerate(zip(raws, groups, at)):
            if place < least or len(raw) < place + behind:
                continue
            other = seen.setdefault((group, raw[place - least : place + behind]), k)
            if other != k:
                for one in (other, k):
                    low[one] = min(low[one], least)
                    high[one] = most
    return low, high


def collection_repeats(texts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of every window of ``window`` symbols that occurs again in the collection.

    Texts are arrays of positive 16-bit symbols. Rows of the transform stand in the order of all suffixes; the
    first ones are the empty suffixes, the others are, in order, the extensions of the rows that have a symbol.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts])
    flat = np.concatenate([np.zeros(1, np.uint16), *texts])  # place 0 stands for the symbol before a whole text
    ends = np.cumsum(size) + 1
    symbol = flat[np.where(size > 0, ends - 1, 0)]
    name = np.arange(m, dtype=np.int32) << SIZE_BITS  # text and length of each suffix
    common = np.zeros(m + 1, dtype=np.int16)  # and a last one for the end
    last = np.arange(m)  # row of each text's longest suffix so far
    for j in range(1, int(size.max(initial=0)) + 1):
        order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol == 0) :]
        longest = np.zeros(len(symbol), dtype=bool)
        longest[last[size >= j]] = True
        fresh = np.flatnonzero(longest[order])
        inserted = name[order[fresh]] >> SIZE_BITS
        # common prefixes at both sides of the inserted rows
        beside = np.union1d(fresh, fresh + 1)
        beside = beside[(beside > 0) & (beside < len(order))]
        low, high = order[beside - 1], order[beside]
        same = symbol[low] == symbol[high]
        between = np.zeros(len(beside), dtype=np.int16)
        if same.any():
            low, high = low[same], high[same]
            back = np.argsort(-low, kind="stable")
            cuts = np.stack([low[back] + 1, high[back] + 1], axis=1).ravel()
            least = np.empty(len(low), dtype=np.int16)
            least[back] = np.minimum.reduceat(common, cuts)[::2] + 1
            between[same] = least
        # the rows that were there keep their order; a row that has been extended keeps its symbol
        rows = m + len(order)
        there = np.ones(rows + 1, dtype=bool)
        there[m + fresh] = False
        grown = np.zeros(rows + 1, dtype=np.int16)
        grown[there] = common
        grown[m + beside] = between
        new_name = np.empty(rows, dtype=name.dtype)
        new_name[there[:-1]] = name
        new_name[m + fresh] = inserted << SIZE_BITS | j
        # only whole texts have no symbol
        new_symbol = np.empty(rows, dtype=symbol.dtype)
        new_symbol[there[:-1]] = symbol
        new_symbol[m + fresh] = flat[np.where(size[inserted] > j, ends[inserted] - j - 1, 0)]
        symbol, name, common = new_symbol, new_name, grown
        last[inserted] = m + fresh
    owner, depth = name >> SIZE_BITS, name & (1 << SIZE_BITS) - 1
    again = np.maximum(common[:-1], common[1:]) >= window
    again &= depth >= window
    return owner[again], size[owner[again]] - depth[again]


def repeated_places(raws: list[bytes], groups: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Run and start of the windows that occur in another run of the same group; runs must differ.

    Only the parts of runs that may hold such a window go into the transform.
    """
    if not raws:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = anchor_offsets(raws, length, anchor)
    low, high = shared_bins(raws, groups.tolist(), at.tolist(), length, anchor)
    kept = np.flatnonzero(high >= 0)
    first = np.maximum(at - high, 0)
    texts = []
    for k in kept.tolist():
        text = np.frombuffer(raws[k], dtype=np.uint8).astype(np.uint16) + np.uint16(1)
        one = np.array([257 + groups[k]], dtype=np.uint16)
        behind = at[k] + anchor
        texts.append(np.concatenate([text[first[k] : at[k]], one, text[behind : behind + length - anchor - low[k]]]))
    run, start = collection_repeats(texts, length - anchor + 1) if texts else (kept, kept)
    return kept[run], start + first[kept[run]]


def _run_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """anchor and content hash, key and place (bits of the text's hash, first byte, size) of every run."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(text_column(batch, "text")):
                doc, first, end, hashes = runs(data, offsets, length, anchor)
                marks = span_hashes(data, offsets[:-1], offsets[1:])
                place = (marks[doc] >> np.uint64(64 - MARK_BITS)).astype(np.int64) << 41
                place |= (first - offsets[doc]) << SIZE_BITS | (end - first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(span_hashes(data, first, end).view(np.int64)),
                    batch.column(0).slice(low, high - low).take(pa.array(doc)), pa.array(place),
                ], names=["anchor", "content", "id", "place"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(lean(describe), f"anchor long, content long, id {kind}, place long")


def _texts_with(docs: DataFrame, extra: DataFrame, name: str) -> DataFrame:
    """Every document with an array column from ``extra`` (id, name), by key; a null key meets a null key."""
    right = extra.withColumnRenamed("id", "other").hint("merge")  # grows with the corpus: never broadcast
    return docs.join(right, docs["id"].eqNullSafe(right["other"]), "left").select("id", "text", name)


def _run_bytes(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The bytes of chosen runs (anchor, content, id, place)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            rows = []
            for k in np.flatnonzero(wanted.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = (batch.column(1)[k].as_py() or "").encode()
                mark = _mark(raw)
                for run in wanted[k].as_py():
                    first, size = run["place"] >> SIZE_BITS & (1 << 31) - 1, run["place"] & (1 << SIZE_BITS) - 1
                    if run["place"] >> 41 & (1 << MARK_BITS) - 1 == mark:
                        rows.append((run["anchor"], run["content"], raw[first : first + size]))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "content", "raw"]
            )

    per_text = chosen.groupBy("id").agg(F.collect_list(F.struct("anchor", "content", "place")).alias("wanted"))
    return _texts_with(docs, per_text, "wanted").mapInArrow(lean(cut), "anchor long, content long, raw binary")


def _mark(raw: bytes) -> int:
    data = np.frombuffer(raw, dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - MARK_BITS))


def _sorted_repeats(raws: DataFrame, blocks: int, length: int, anchor: int) -> DataFrame:
    """Repeated stretches (low, high: first window and end of the last) of runs, block by block."""

    def find(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["anchor", "content"])
        groups = np.unique(block["anchor"].to_numpy(), return_inverse=True)[1]
        run, start = repeated_places(block["raw"].tolist(), groups, length, anchor)
        order = np.lexsort((start, run))
        run, start = run[order], start[order]
        head = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)]) if len(run) else run
        tail = np.r_[head[1:], len(run)] - 1 if len(run) else run
        return pd.DataFrame({
            "anchor": block["anchor"].to_numpy()[run[head]], "content": block["content"].to_numpy()[run[head]],
            "low": start[head], "high": start[tail] + length,
        })

    return raws.groupBy(F.pmod("anchor", F.lit(blocks)).alias("block")).applyInPandas(
        find, "anchor long, content long, low long, high long"
    )


def _counted_repeats(raws: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many runs: each window is counted by anchor and hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                hashes = gram_hashes(np.frombuffer(batch.column(2)[k].as_py(), dtype=np.uint8), length)
                n = len(hashes)
                same = [pa.array(np.full(n, batch.column(c)[k].as_py())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n)), pa.array(hashes.view(np.int64))], names=names)

    names = ["anchor", "content", "low", "window"]
    every = raws.mapInArrow(lean(windows), "anchor long, content long, low long, window long")
    again = every.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
    return every.join(again, ["anchor", "window"]).select("anchor", "content", "low", (F.col("low") + length).alias("high"))


def _hot(counts: DataFrame, *keys: str) -> DataFrame:
    """Keys with over 1 / SHARES of all rows counted in n (so under SHARES), and among how many salts to deal each."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * SHARES > F.lit(total))
    return stored(often.select(*keys, F.ceil(F.col("n") * SHARES / F.lit(total)).cast("int").alias("salts")), "hot")


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with a salt, 0 unless their key is hot."""
    rows = rows.join(F.broadcast(hot), hot.columns[:-1], "left")
    return rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "place"), "salts").cast("int"), F.lit(0))).drop("salts")


def _for_all_salts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows once for every salt of their key; with one row a key that adds at most 2 * SHARES rows."""
    rows = rows.join(F.broadcast(hot), hot.columns[:-1], "left")
    last = F.coalesce("salts", F.lit(1)) - 1
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    block_runs: int = BLOCK_RUNS, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """What is left of every text: key, n_bytes, n_removed, n_spans and kept (the remaining bytes).

    Texts are taken as UTF-8 bytes; matches never cross documents, but may lie in the same document. Null and
    empty texts have no bytes; texts shorter than a window stay whole. Rows that are repeated as a whole are
    repeats of each other. A null key is a key like any other. Other columns are not read.
    """
    if not anchor <= length < 1 << SIZE_BITS - 1:
        raise ValueError("a window must be at least as long as an anchor and shorter than 512 bytes")
    docs = on_workers(docs).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(_run_rows(docs, length, anchor), "found")
    counts = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")
    )
    several = stored(counts.where("n > 1").select("anchor", "n", (F.col("low") == F.col("high")).alias("alike")), "several")
    hot = _hot(several, "anchor")
    places = _for_all_salts(several.drop("n"), hot)
    shared = stored(_dealt(found, hot).join(places.hint("merge"), ["anchor", "salt"]), "runs")
    # the different runs of an anchor; those that occur several times repeat as a whole
    kinds = shared.where("not alike").groupBy("anchor", "content").agg(
        F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    kinds = stored(kinds.select("anchor", "content", "first.id", "first.place", "n"), "kinds")
    crowded = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > hot_runs)
    crowded = stored(crowded.select("anchor"), "crowded")
    blocks = max(1, -(-kinds.count() // block_runs))
    raws = stored(_run_bytes(docs, kinds), "raws")
    stretches = _sorted_repeats(raws.join(crowded, "anchor", "left_anti"), blocks, length, anchor)
    if not crowded.isEmpty():
        stretches = stretches.unionAll(_counted_repeats(raws.join(crowded, "anchor", "left_semi"), length))
    # a span is written like the place of a run; the stretches of a content stay in one row
    whole = shared.where("alike").select("id", F.array("place").alias("spans"))
    twice = kinds.where("n > 1").select("anchor", "content", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    stretches = stretches.unionAll(twice).groupBy("anchor", "content").agg(
        F.collect_list(F.struct("low", "high")).alias("stretches")
    )
    hot = _hot(kinds, "anchor", "content")
    start = F.col("place") - F.col("place").bitwiseAND((1 << SIZE_BITS) - 1)
    part = lambda s: F.coalesce(start + F.shiftleft(s["low"], SIZE_BITS) + s["high"] - s["low"], "place")
    parts = _dealt(shared.where("not alike").drop("salt"), hot).join(
        _for_all_salts(stretches, hot).hint("merge"), ["anchor", "content", "salt"]
    ).select("id", F.transform("stretches", part).alias("spans"))
    spans = whole.unionAll(parts).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                rows = [_stripped(t.as_py().encode(), s.as_py()) for t, s in zip(part.column(1), part.column(2))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["id"].dataType.simpleString()
    return _texts_with(docs, spans, "spans").mapInArrow(lean(strip), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def _stripped(raw: bytes, spans: list[int] | None) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, and what is left."""
    if not spans:
        return len(raw), 0, 0, raw
    mark = _mark(raw)
    kept, at, removed, number = [], 0, 0, 0
    for span in sorted(s for s in spans if s >> 41 == mark):
        low = span >> SIZE_BITS & (1 << 31) - 1
        high = low + (span & (1 << SIZE_BITS) - 1)
        if low > at or not number:
            kept.append(raw[at:low])
            number += 1
            removed += high - low
            at = high
        elif high > at:
            removed += high - at
            at = high
    kept.append(raw[at:])
    return len(raw), removed, number, b"".join(kept)

