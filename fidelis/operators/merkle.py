"""A verifiable release: a Merkle tree over ranges of key digests, proofs of inclusion, and differences by subtree."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.operators.guard import guard
from fidelis.sources.scratch import Scratch

#: A leaf range holds about so many entries at most; each level above has a sixteenth as many nodes.
RANGE = 256


def leaves(entries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(path, leaf, key): an entry's place, the digest of its key, and the digest of its key and columns as JSON with nulls.

    A null key or one that is there twice stops the run.
    """
    said = F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"})
    rows = entries.select(F.sha2(F.col(key).cast("string"), 256).alias("path"), F.sha2(F.concat(F.lit("leaf:"), said), 256).alias("leaf"), F.col(key).cast("string").alias("key"))
    one = rows.groupBy("path").agg(F.count("*").alias("__n"), F.min("leaf").alias("leaf"), F.min("key").alias("key"))
    return guard(one, F.col("path").isNotNull() & (F.col("__n") == 1), "a key of the release is null or repeated").select("path", "leaf", "key")


def depth_of(n: int, most: int = RANGE) -> int:
    """The least depth at which ranges hold `most` entries on average or fewer."""
    depth = 0
    while n > most * 16**depth:
        depth += 1
    return depth


def _node(parts: Column) -> Column:
    """The digest of sorted (place, digest) pairs."""
    return F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform(F.sort_array(parts), lambda p: F.concat(p["place"], p["digest"])), "")), 256)


def tree(of: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, digest, n) of all nodes that have entries, the root at level 0 with an empty prefix; of: rows of leaves.

    A range of leaves is one small group, as paths are digests; a node above has sixteen children at most. Each level is
    written, and the next one reads only that.
    """
    scratch = Scratch(of.sparkSession, "merkle")
    pair = lambda place, digest: F.collect_list(F.struct(F.col(place).alias("place"), F.col(digest).alias("digest")))
    low = of.groupBy(F.substring("path", 1, depth).alias("prefix")).agg(_node(pair("path", "leaf")).alias("digest"), F.count("*").alias("n"))
    levels = [scratch.write(low, f"level-{depth}")]
    for d in range(depth - 1, -1, -1):
        up = levels[-1].groupBy(F.substring("prefix", 1, d).alias("up")).agg(_node(pair("prefix", "digest")).alias("digest"), F.sum("n").alias("n"))
        levels.append(scratch.write(up.withColumnRenamed("up", "prefix"), f"level-{d}"))
    named = [df.select(F.lit(depth - i).cast("long").alias("level"), "prefix", "digest", "n") for i, df in enumerate(levels)]
    return reduce(DataFrame.unionAll, named)


def root(nodes: DataFrame) -> str | None:
    """The root's digest; None for an empty release."""
    held = nodes.where("level = 0").select("digest").first()
    return held and held.digest


def proof(nodes: DataFrame, of: DataFrame, key: str) -> list[list[tuple[str, str]]]:
    """What a holder of one entry needs: the (place, digest) pairs of its range, and of the children of each node above it."""
    path = hashlib.sha256(key.encode()).hexdigest()
    depth = nodes.agg(F.max("level")).first()[0] or 0
    out = [[tuple(r) for r in of.where(F.col("path").startswith(path[:depth])).select("path", "leaf").orderBy("path").collect()]]
    for d in range(depth, 0, -1):
        out.append([tuple(r) for r in nodes.where((F.col("level") == d) & F.col("prefix").startswith(path[: d - 1])).select("prefix", "digest").orderBy("prefix").collect()])
    return out


def verify(key: str, leaf: str, given: list[list[tuple[str, str]]], expected: str) -> bool:
    """Whether the proof leads from the entry's leaf digest to the expected root."""
    path, digest, depth = hashlib.sha256(key.encode()).hexdigest(), leaf, len(given) - 1
    for i, pairs in enumerate(given):
        place = path if i == 0 else path[: depth - i + 1]
        if (place, digest) not in [tuple(p) for p in pairs] or [p[0] for p in pairs] != sorted({p[0] for p in pairs}):
            return False
        digest = hashlib.sha256(("node:" + "".join(a + b for a, b in pairs)).encode()).hexdigest()
    return digest == expected


def difference(a: DataFrame, a_leaves: DataFrame, b: DataFrame, b_leaves: DataFrame) -> DataFrame:
    """(key, kind): entries that b adds, removes or changes against a, found below nodes that differ only.

    Both trees must be of one depth: build the smaller release's at the other's.
    """
    depths = [df.agg(F.max("level")).first()[0] for df in (a, b)]
    if len({d for d in depths if d is not None}) > 1:
        raise ValueError(f"trees of different depths: {depths}")
    depth = max((d for d in depths if d is not None), default=0)
    unlike = None
    for d in range(depth + 1):
        sides = [df.where(F.col("level") == d).select("prefix", F.col("digest").alias(name)) for df, name in ((a, "x"), (b, "y"))]
        if unlike is not None:
            above = unlike.withColumnRenamed("prefix", "__up")
            sides = [s.withColumn("__up", F.substring("prefix", 1, d - 1)).join(above, "__up", "left_semi").drop("__up") for s in sides]
        unlike = sides[0].join(sides[1], "prefix", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix")
    near = [df.withColumn("prefix", F.substring("path", 1, depth)).join(unlike, "prefix", "left_semi").select("path", F.col("leaf").alias(f"l_{s}"), F.col("key").alias(f"k_{s}")) for df, s in ((a_leaves, "x"), (b_leaves, "y"))]
    both = near[0].join(near[1], "path", "full_outer").where(~F.col("l_x").eqNullSafe(F.col("l_y")))
    kind = F.when(F.col("l_x").isNull(), "added").when(F.col("l_y").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("k_x", "k_y").alias("key"), kind.alias("kind"))
