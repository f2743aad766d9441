"""Assembly of log blocks: a header line opens a block, later lines fill its cells.

``assemble`` reads the lines once and shuffles only the lines that matter, in two bounded steps:

1. by chunk of a file: number the headers within the chunk, one row per block part;
2. by file, but only the first and last part of each chunk meet there (all other parts are
   complete and keep their own key), so a block that crosses a chunk border is put together.

The second step holds at most two rows per chunk of a file, however large the file is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackmeter.sources.lines import chunk_of


@dataclass(frozen=True)
class Rule:
    """Lines for which ``when`` holds give the cells ``names`` from the array ``cells``."""

    names: Sequence[str]
    when: Column
    cells: Column


@dataclass(frozen=True)
class Tally:
    """Lines whose cells are summed and counted, in whatever block they stand or outside of all.

    With ``after`` only lines that directly follow a line for which it holds.
    """

    names: Sequence[str]
    when: Column
    cells: Column
    after: Column | None = None


WAITING = -1


def _marked(
    lines: DataFrame, header: Column, rules: Sequence[Rule], every_rule: bool, tallies: Sequence[Tally] = ()
) -> DataFrame:
    """Lines that matter: kind 0 for headers, k for the k-th rule, then one for each tally, with the parsed cells.

    A line that a tally waits for puts a row of kind ``WAITING`` at the place where the next line starts.
    """
    tests = [header] + [rule.when for rule in rules]
    kinds = [F.when(test, F.lit(k)) for k, test in enumerate(tests)]
    base = [F.col("file"), F.col("split"), F.col("line")]
    if every_rule or tallies:
        at = lambda place, kind: F.struct(place.alias("pos"), kind.alias("kind"))
        first = kinds if every_rule else [F.coalesce(*kinds)]
        hits = [F.when(k.isNotNull(), at(F.col("pos"), k)) for k in first]
        after = F.col("next") if "next" in lines.columns else F.col("pos") + 1
        for k, tally in enumerate(tallies, start=len(tests)):
            hits.append(F.when(tally.when, at(F.col("pos"), F.lit(k))))
            if tally.after is not None:
                hits.append(F.when(tally.after, at(after, F.lit(WAITING))))
        found = F.filter(F.array(*hits), lambda k: k.isNotNull())
        kept = lines.select(*base, F.explode(found).alias("k")).select(*base, "k.pos", "k.kind")
    else:
        kept = lines.select(*base, "pos", F.coalesce(*kinds).alias("kind")).where(F.col("kind").isNotNull())
    parsed = [(k, r.cells) for k, r in enumerate([*rules, *tallies], start=1)]
    cells = F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in parsed])
    width = max(len(rule.names) for rule in [*rules, *tallies])
    return kept.select(
        "file", "split", chunk_of(F.col("pos")).alias("chunk"), "pos", "kind",
        F.when(F.col("kind") == 0, F.col("line")).alias("opener"),
        cells.alias("cells"),
    ).select(
        "file", "split", "chunk", "pos", "kind", "opener",
        *[F.expr(f"get(cells, {i}) as v{i}") for i in range(width)],
    )


def assemble(
    lines: DataFrame,
    header: Column,
    rules: Sequence[Rule],
    keep_last: bool = False,
    every_rule: bool = False,
    tallies: Sequence[Tally] = (),
) -> DataFrame:
    """One row per block: file, header, block_split, block_pos, then the cells of all rules.

    Lines before the first header are dropped; so is the last block of each file (it may be cut
    off) unless ``keep_last``. A line counts for the first rule it meets, or for all of them with
    ``every_rule``. If several lines fill a cell the last one wins.

    With ``tallies`` each row also has ``<name>_sum`` and ``<name>_n``, and there are rows with ``complete`` false for
    the blocks and lines that would be dropped, so that all kinds of records come from one reading of the lines.
    """
    chunk_keys = ["file", "chunk"]
    upto = (Window.unboundedPreceding, Window.currentRow)
    by_place = Window.partitionBy(*chunk_keys).orderBy("pos", "kind")
    in_chunk = by_place.rowsBetween(*upto)
    is_opener = (F.col("kind") == 0).cast("int")
    awaited = F.last(F.when(F.col("kind") == WAITING, F.col("pos")), ignorenulls=True).over(in_chunk) == F.col("pos")
    numbered = _marked(lines, header, rules, every_rule, tallies).select(
        "*",
        F.sum(is_opener).over(in_chunk).alias("local"),
        # Counted in the same order, so that the wide rows of block parts are not sorted once more for it.
        F.sum(is_opener).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_local"),
        F.last("opener", ignorenulls=True).over(in_chunk).alias("header"),
        *[awaited.alias("awaited")] * any(t.after is not None for t in tallies),
    )
    cells = [(name, k, i) for k, rule in enumerate(rules, start=1) for i, name in enumerate(rule.names)]
    sums = []
    for k, tally in enumerate(tallies, start=len(rules) + 1):
        hit = (F.col("kind") == k) & (F.col("awaited") if tally.after is not None else F.lit(True))
        for i, name in enumerate(tally.names):
            value = F.when(hit, F.col(f"v{i}"))
            sums += [(f"{name}_sum", F.sum(value)), (f"{name}_n", F.count(value))]
    parts = numbered.groupBy(*chunk_keys, "local", "last_local", "header").agg(
        F.max(F.when(F.col("kind") == 0, F.col("pos"))).alias("opened"),
        F.min(F.when(F.col("kind") == 0, F.col("split"))).alias("split"),
        *[
            F.expr(f"max_by(v{i}, case when kind = {k} and v{i} is not null then pos end) as `{name}`")
            for name, k, i in cells
        ],
        *[value.alias(name) for name, value in sums],
    )
    is_edge = (F.col("local") == 0) | (F.col("local") == F.col("last_local"))
    parts = parts.withColumn("edge", is_edge).withColumn("own_chunk", F.when(~F.col("edge"), F.col("chunk")))
    part_keys = ["file", "own_chunk"]
    whole = Window.partitionBy(*part_keys)
    in_order = whole.orderBy("chunk", "local")
    opens = F.col("opened").isNotNull().cast("int")
    owned = parts.withColumns(
        {
            "owner": F.sum(opens).over(in_order.rowsBetween(*upto)),
            "owners": F.sum(opens).over(whole),
            "rank": F.row_number().over(in_order),
            "header": F.last("header", ignorenulls=True).over(in_order.rowsBetween(*upto)),
        }
    )
    complete = F.col("owner") > 0
    if not keep_last:
        complete = complete & ~(F.col("edge") & (F.col("owner") == F.col("owners")))
    owned = owned.withColumn("complete", complete) if tallies else owned.where(complete)
    return (
        owned.groupBy(*part_keys, "owner", "header", *["complete"] * bool(tallies))
        .agg(
            F.max(F.when(F.col("opened").isNotNull(), F.col("split"))).alias("block_split"),
            F.max("opened").alias("block_pos"),
            *[
                F.expr(f"max_by(`{name}`, case when `{name}` is not null then rank end) as `{name}`")
                for name, _, _ in cells
            ],
            *[F.sum(name).alias(name) for name, _ in sums],
        )
        .drop("own_chunk", "owner")
    )


def line_after(
    lines: DataFrame, marker: Column, candidate: Column, names: Sequence[str], cells: Column
) -> DataFrame:
    """Cells of the line that directly follows a marker line, one row per marker.

    ``candidate`` tells the lines that can be read; a marker before another line gives no row. A marker waits at the
    place where it ends and a readable line at the place where it starts, so both meet by place, however the file
    was cut and whichever lines were dropped before. No key has more than two rows.
    """
    after = F.col("next") if "next" in lines.columns else F.col("pos") + 1
    at = lambda place, opened, values: F.struct(place.alias("at"), opened.alias("opened"), values.alias("cells"))
    none = F.lit(None).cast("bigint")
    meets = F.filter(
        F.array(
            F.when(marker, at(after, F.col("pos"), F.lit(None).cast(_kind(lines, cells)))),
            F.when(candidate & ~marker, at(F.col("pos"), none, cells)),
        ),
        lambda m: m.isNotNull(),
    )
    met = lines.select("file", "split", F.explode(meets).alias("m")).select(
        "file", "split", "m.at", "m.opened", *[F.expr(f"get(m.cells, {i}) as v{i}") for i in range(len(names))],
        F.col("m.opened").isNull().cast("int").alias("read"),
    )
    pairs = met.groupBy("file", "at").agg(
        F.max(F.when(F.col("opened").isNotNull(), F.col("split"))).alias("block_split"), F.max("opened").alias("block_pos"),
        F.max("read").alias("read"), *[F.max(f"v{i}").alias(name) for i, name in enumerate(names)],
    )
    return pairs.where(F.col("block_pos").isNotNull() & (F.col("read") == 1)).select("file", "block_split", "block_pos", *names)


def _kind(lines: DataFrame, cells: Column) -> str:
    return lines.limit(0).select(cells.alias("c")).schema["c"].dataType.simpleString()
