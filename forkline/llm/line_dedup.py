"""Cross-site boilerplate lines by distinct-site spread.

Each line gets a HyperLogLog sketch of the sites it is on; sketches merge in the
aggregation, first within a task and then across. The sketch decides clear cases, lines
whose estimate is near the threshold are counted exactly, and the lines that reach it are
removed from every document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_name, fresh, ship, small, text_bytes, written

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 12
#: Estimates this share around the threshold are counted exactly: six standard errors of a
#: sketch with 2**12 registers.
NEAR, LG_K = 0.1, 12
#: Counted bytes of the near-threshold lines that may be broadcast.
BROADCAST_BYTES = 64 << 20


def _lines(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    found = docs.select(docs[site_col].cast("string").alias("site"), F.explode(F.split(docs[text_col], "\n", -1)).alias("line"))
    return found.where((F.trim("line") != "") & F.col("site").isNotNull()).withColumn("h", F.xxhash64("line"))


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """(line): the lines that are on at least `min_sites` distinct sites.

    Blank lines never are; a row without a site adds no site. Lines are told apart by their
    content: the hash only partitions them.
    """
    lines = _lines(docs, site_col, text_col)
    # A line on k sites occurs k times at least: the rest need no sketch.
    often = written(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h"))
    asked = lines.join(F.broadcast(often) if small(often) else often, "h")
    spread = written(asked.groupBy("h", "line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("h", "line", F.hll_sketch_estimate("sketch").alias("sites")))
    clear = spread.where(F.col("sites") >= min_sites * (1 + NEAR)).select("line")
    near = spread.where((F.col("sites") < min_sites * (1 + NEAR)) & (F.col("sites") > min_sites * (1 - NEAR))).select("h", "line")
    exact = asked.join(F.broadcast(near) if small(near) and text_bytes(near, "line") <= BROADCAST_BYTES else near, ["h", "line"]).groupBy("h", "line").agg(F.countDistinct("site").alias("sites"))
    return clear.unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, broadcast_lines: int = 200_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """All rows and columns of `docs`, with the boilerplate lines taken out of the text, and
    `n_removed` (under a free name).

    A null text stays null with 0 removed; a text of boilerplate lines only becomes empty;
    all other lines keep their order, repeated ones included. Rows aren't merged.

    Up to `broadcast_lines` lines of `broadcast_bytes` together, both counted, are sent to the
    tasks, and the documents are rewritten in one narrow pass. Beyond that the documents' lines are joined with them by hash and each
    document gets the numbers of its lines to drop.
    """
    ship(docs.sparkSession)
    n_removed = fresh("n_removed", docs)
    lines = written(boilerplate_lines(docs, site_col, text_col, min_sites))
    if small(lines, broadcast_lines) and text_bytes(lines, "line") <= broadcast_bytes:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in lines.collect()))
        at = docs.columns.index(text_col)

        def run(batches):
            drop = known.value
            for b in batches:
                texts, counts = [], []
                for t in b.column(at).to_pylist():
                    parts = t.split("\n") if t is not None else []
                    kept = [x for x in parts if x not in drop]
                    counts.append(len(parts) - len(kept))
                    texts.append(t if len(kept) == len(parts) else "\n".join(kept))
                columns = list(b.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*b.schema.names, n_removed])

        return docs.mapInArrow(run, drop_name(docs, n_removed, "long"))

    key, numbers = fresh("_key", docs), fresh("_numbers", docs)
    # Equal texts lose the same lines: a row's key is its text's hash and length. Of two texts
    # that share a key each loses only lines whose own hash is that of a line to drop.
    keyed = docs.withColumn(key, F.struct(F.xxhash64(text_col), F.hash(text_col), F.length(text_col)))
    each = keyed.where(F.col(text_col).isNotNull()).select(key, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line")).withColumn("h", F.xxhash64("line"))
    hits = each.join(lines.withColumn("h", F.xxhash64("line")), ["h", "line"], "left_semi")
    drops = written(hits.groupBy(key).agg(F.collect_set(F.struct("n", "h")).alias(numbers)))
    joined = keyed.join(drops, key, "left")
    parts = F.split(text_col, "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.col(numbers), F.struct(i.alias("n"), F.xxhash64(x).alias("h"))))
    return joined.select(
        *[F.when(F.col(numbers).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(numbers).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(kept)).cast("long").alias(n_removed),
    )
