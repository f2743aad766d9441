"""Near-duplicate groups by compressed minimum hashes.

A document is the set of its word shingles. HyperMinHash keeps of the least hash value in each register the
number of leading zeros and a few bits after them (16 bits in all). The shingles of a large set are dealt into
the registers by one hash; those of a small set, which would leave registers empty and bands unspecific,
count in every register. Runs of registers make up bands. Documents that agree in a band, of which at least one register is
filled, are candidates; the share of agreeing registers, corrected for agreement by chance, estimates their
similarity; what stays above the threshold less six standard errors is confirmed on the full sets.

Documents with the same set are one node from the start. In each band bucket all members are first paired
with one of them only, that which shares most buckets with others and so is the likely origin of the copies.
Links found so join most of each group. In buckets that still hold several components, a prefix filter on the full
sets gives the pairs of members of different components that can still be links. A link between two
documents of a bucket is thus only left out if both are known to be connected, so groups are the same as
with all pairs, without listing the pairs of large groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackmeter.llm.common import lean, mix64, on_workers, span_hashes, stored, text_column, text_slices, with_row_keys, word_spans
from rackmeter.llm.graph import components

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets of up to SMALL shingles count each shingle in all registers, sets of more than LARGE deal them out. The
#: overlap holds all sizes that a set of LARGE shingles can be linked with.
LARGE, SMALL = 640, 800
SIMILARITY = 80
STANDARD_ERRORS = 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and where each text's begin.

    A text with fewer words than a shingle has its whole sequence of words as only shingle.
    """
    starts, ends, doc = word_spans(data, offsets)
    docs = len(offsets) - 1
    hashes = span_hashes(data, starts, ends, fold=True)
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = mix64(rolled + hashes[k : k + len(rolled)])
    sets = []
    for n, at in zip(count.tolist(), first.tolist()):
        if n >= words:
            sets.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            whole = np.uint64(n)
            for k in range(at, at + n):
                whole = mix64(whole + hashes[k : k + 1])[0]
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)]


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers of 32-bit values: leading zeros (plus one) and the bits after the leading one."""
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    zeros = 32 - bits
    after = least.astype(np.uint64) << (zeros + 1).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | after >> np.uint64(32 - MANTISSA)).astype(np.uint16)


def dealt_registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of registers per large set: each shingle goes to one register, 0 is an empty one."""
    docs = len(bounds) - 1
    out = np.zeros(docs * REGISTERS, dtype=np.uint16)
    if len(values):
        scrambled = mix64(values ^ np.uint64(0x5851F42D4C957F2D))
        register = (scrambled >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
        owner = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(bounds)) * np.uint64(REGISTERS) + register
        keys = np.sort(owner << np.uint64(32) | scrambled & np.uint64(0xFFFFFFFF))
        cell = (keys >> np.uint64(32)).astype(np.int64)
        head = np.r_[True, cell[1:] != cell[:-1]]
        out[cell[head]] = compressed(keys[head] & np.uint64(0xFFFFFFFF))
    return out.reshape(docs, REGISTERS)


_FACTORS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def filled_registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of registers per small set: each shingle counts in all registers, by a hash for each."""
    out = np.empty((len(bounds) - 1, REGISTERS), dtype=np.uint32)
    scrambled = mix64(values ^ np.uint64(0x1D8E4E27C47D124F))
    for row, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        out[row] = (np.multiply.outer(_FACTORS, scrambled[low:high]) >> np.uint64(32)).min(axis=1)
    return compressed(out)


def band_keys(rows: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands of each row, and whether the band has a filled register."""
    bands = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    first = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(1000 * kind))
    keys = np.broadcast_to(first, bands.shape[:2])
    for k in range(ROWS):
        keys = mix64(keys + bands[:, :, k])
    return keys, bands.any(axis=2)


def by_chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that registers with the given mean numbers of different shingles hold the same filled value."""
    zeros = 0.5 ** np.arange(0, 33)
    fill = lambda n: np.exp(-np.outer(n, zeros[1:])) - np.exp(-np.outer(n, zeros[:-1]))
    return (fill(a) * fill(b)).sum(axis=1) / (1 << MANTISSA)


def estimate(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of register rows with ``a`` and ``b`` shingles per register, and its standard error at 0.8."""
    filled = np.maximum(1, ((left > 0) | (right > 0)).sum(axis=1))
    same = ((left == right) & (left > 0)).sum(axis=1)
    chance = by_chance(a, b) * REGISTERS
    return (same - chance) / np.maximum(1e-9, filled - chance), np.sqrt(0.16 / filled)


def signatures(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """id, n_shingles, a 128-bit hash of the set and the registers (of one or both forms) of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(text_column(batch, "text")):
                values, bounds = shingle_sets(data, offsets, words)
                size = np.diff(bounds)
                rows = []
                for chosen, make in (((size > 0) & (size <= SMALL), filled_registers), (size > LARGE, dealt_registers)):
                    part = np.r_[0, np.cumsum(size[chosen])]
                    made = iter(make(values[np.repeat(chosen, size)], part))
                    rows.append([next(made).tobytes() if c else None for c in chosen.tolist()])
                sums = [np.r_[np.uint64(0), np.cumsum(mix64(values ^ np.uint64(s)), dtype=np.uint64)] for s in (17, 91)]
                columns = [
                    batch.column(0).slice(low, high - low), pa.array(size),
                    *(pa.array(np.diff(s[bounds]).view(np.int64)) for s in sums),
                    *(pa.array(r, pa.binary()) for r in rows),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_shingles", "set_a", "set_b", "filled", "dealt"]
    return on_workers(docs).select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(lean(describe), f"id {docs.schema[key].dataType.simpleString()}, n_shingles long, set_a long, set_b long, filled binary, dealt binary"
    )


def _rows(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(r, dtype=np.uint16) for r in column.to_pylist()])


def bands(sets: DataFrame) -> DataFrame:
    """(band, id): a row per band with a filled register."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.slice(low, 4096)
                for kind in (1, 2):
                    rows = part.filter(part.column(kind).is_valid())
                    if len(rows):
                        keys, filled = band_keys(_rows(rows.column(kind)), kind)
                        at = np.r_[0, np.cumsum(filled.sum(axis=1))].astype(np.int32)
                        lists = pa.ListArray.from_arrays(at, pa.array(keys[filled].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["id", "bands"])

    kind = sets.schema["id"].dataType.simpleString()
    found = sets.select("id", "filled", "dealt").mapInArrow(lean(split), f"id {kind}, bands array<long>")
    return found.select(F.explode("bands").alias("band"), "id")


def _plausible() -> Column:
    @F.arrow_udf("boolean")
    def plausible(*columns: pa.Array) -> pa.Array:
        """Whether the estimate leaves a link possible."""
        fa, fb, da, db, na, nb = columns
        sizes = [n.to_numpy(zero_copy_only=False).astype(float) for n in (na, nb)]
        out = 100 * np.minimum(*sizes) >= SIMILARITY * np.maximum(*sizes)
        small = pc.and_(fa.is_valid(), fb.is_valid()).to_numpy(zero_copy_only=False)
        for a, b, which, load in ((fa, fb, small, 1), (da, db, ~small, REGISTERS)):
            at = np.flatnonzero(which & out)
            for part in np.array_split(at, -(-len(at) // 4096)) if len(at) else []:
                similarity, error = estimate(
                    _rows(a.take(pa.array(part))), _rows(b.take(pa.array(part))), sizes[0][part] / load, sizes[1][part] / load
                )
                out[part] = similarity >= SIMILARITY / 100 - STANDARD_ERRORS * error
        return pa.array(out)

    return plausible("fa", "fb", "da", "db", "na", "nb")


def _linked(words: int) -> Column:
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        """Whether 100 * |intersection| >= 80 * |union| of the full sets."""
        out, held = [], {}
        for a, b in zip(left, right):
            sets = []
            for value in (a, b):
                raw = value.as_py()
                if raw not in held:
                    if len(held) > 64:
                        held.clear()
                    data = np.frombuffer(raw.encode(), dtype=np.uint8)
                    held[raw] = shingle_sets(data, np.array([0, len(data)]), words)[0]
                sets.append(held[raw])
            common = len(np.intersect1d(*sets, assume_unique=True))
            out.append(100 * common >= SIMILARITY * (len(sets[0]) + len(sets[1]) - common) and common > 0)
        return pa.array(out, pa.bool_())

    return linked("ta", "tb")


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    side = lambda e: sets.select(F.col("id").alias(e), F.col("filled").alias(f"f{e}"), F.col("dealt").alias(f"d{e}"), F.col("n_shingles").alias(f"n{e}"))
    likely = stored(
        pairs.join(side("a"), "a").join(side("b"), "b").where(_plausible()).select("a", "b"), "likely"
    )
    text = lambda e: texts.select(F.col("id").alias(e), F.col("text").alias(f"t{e}"))
    return likely.join(text("a"), "a").join(text("b"), "b").where(_linked(words)).select("a", "b")


def sharing_rare(chosen: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) of chosen documents (id, component, n_shingles) of different components that can be links.

    Two sets of similarity 0.8 must share a number of shingles that follows from their sizes, so with shingles
    ordered from rare to frequent their first shared one stands early in both. No link is left out, and
    what many documents share is rarely that early in a set that is not linked with any of them.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(text_column(batch, "text")):
                values, bounds = shingle_sets(data, offsets, words)
                owner = pa.array(np.repeat(np.arange(low, high), np.diff(bounds)))
                rest = [batch.column(c).take(owner) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(values.view(np.int64))], names=names)

    names = ["id", "component", "n_shingles", "shingle"]
    kind = chosen.schema["id"].dataType.simpleString()
    rows = chosen.join(texts, "id").select("id", "component", "n_shingles", "text").mapInArrow(lean(split), f"id {kind}, component {kind}, n_shingles long, shingle long"
    )
    rows = stored(rows, "shingles")
    rarity = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("rarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("rarity", "shingle"))
    least = F.ceil(F.col("n_shingles") * SIMILARITY / 100)
    head = rows.join(rarity, "shingle").withColumn("rank", rank).where(F.col("rank") <= F.col("n_shingles") - least + 1)
    head = stored(head.where("rarity > 1").select("id", "component", "n_shingles", "shingle", "rank"), "rare")
    other = head.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("id", "component", "n_shingles", "rank")])
    # shingles that sets of these sizes must share; a shared one further back leaves too few behind it
    common = F.ceil((F.col("n_shingles") + F.col("other_n_shingles")) * SIMILARITY / (100 + SIMILARITY))
    early = (F.col("rank") <= F.col("n_shingles") - common + 1) & (F.col("other_rank") <= F.col("other_n_shingles") - common + 1)
    pairs = head.join(other, "shingle").where((F.col("component") != F.col("other_component")) & (F.col("id") < F.col("other_id")) & early)
    return pairs.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()


def without_duplicates(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of the smallest key, with all its columns.

    Each row is a document of its own, whatever its key: of rows that are alike but for a null or repeated key one is
    left, and different texts under one key are judged apart. Among equal keys the first row of the files stays.
    Rows without words stay.
    """
    rows = with_row_keys(docs, "row_key")
    names = rows.withColumn("row_key", F.struct(F.col(key).isNull().alias("late"), F.col(key).alias("key"), "row_key"))
    gone = near_duplicates(names, words, "row_key", text).where("not kept").select(F.col("row_key.row_key").alias("row_key"))
    return rows.join(gone, "row_key", "left_anti").select(docs.columns)


def near_duplicates(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of near-duplicates: key, n_shingles, component_id and kept, a row per row of ``docs``.

    A document is linked with all whose sets have a similarity of at least 0.8; a component is all that can
    be reached over links, named by its smallest key, and that document is kept. Texts without words (null,
    empty, only white space) have an empty set and are linked with nothing. Rows that repeat a key are
    one document, linked with what any of its texts is linked with; its rows share a component (but for rows without
    words, which are alone). A row with a null key is linked with nothing, has a null component and is kept.
    Other columns are not read.
    """
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = stored(signatures(docs, words, key, text), "signatures")
    real = marks.where("n_shingles > 0 and id is not null")
    first = F.min(F.struct("id", "n_shingles", "filled", "dealt"))
    sets = stored(real.groupBy("set_a", "set_b").agg(first.alias("first")).select("set_a", "set_b", "first.*"), "sets")
    sizes = bands(sets).groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(bands(sets).join(sizes, "band"), "members")
    # the member that shares most buckets with most others is the likely origin of the copies in a bucket
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = members.select("band", "id").join(degree, "id")
    hub = F.max_by("id", F.struct("degree", F.xxhash64("id"))).alias("hub")
    hubs = stored(members.select("band", "id").join(ranked.groupBy("band").agg(hub), "band"), "hubs")
    pairs = hubs.where("id != hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    # a key with several texts is one document: it links the sets of all of them
    several = real.groupBy("id").agg(F.min(F.struct("set_a", "set_b")).alias("low"), F.max(F.struct("set_a", "set_b")).alias("high"))
    several = real.join(several.where("low < high").select("id"), "id").select("id", "set_a", "set_b")
    own = several.join(sets.select("set_a", "set_b", F.col("id").alias("node")), ["set_a", "set_b"])
    own = own.select(F.least("id", "node").alias("a"), F.greatest("id", "node").alias("b")).where("a < b")
    links = stored(confirmed(pairs, sets, texts, words).unionAll(own).distinct(), "links")
    known = components(links)
    placed = members.select("band", "id").join(known.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", F.coalesce("component", "id").alias("component")
    )
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = stored(placed.join(mixed.select("band"), "band").select("id", "component").distinct(), "apart")
    across = sharing_rare(apart.join(sets.select("id", "n_shingles"), "id"), texts, words)
    more = confirmed(across, sets, texts, words)
    groups = components(links.unionAll(more))
    # rows with the same set go with the first of them
    leaders = marks.join(sets.select("set_a", "set_b", F.col("id").alias("node")), ["set_a", "set_b"], "left")
    leaders = leaders.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return leaders.join(groups, "node", "left").select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
