"""A Merkle manifest of a table: content-addressed records, and proofs by descent from the root.

Every row is a leaf. The leaves of a group (``source``) ascend by id; while several nodes remain, every ``FAN``
consecutive ones become their digest, and the last one is the group's subroot. Subroots in the order of the groups are
raised to the root in the same way. Digests are SHA-256; a node is the digest of its children's lower-case hex digits.

The store holds, for each height, records ``digest -> children``, the children being one binary of 32 bytes each. A leaf
is asked for by its ranks: the digits of its group's rank to base ``FAN`` choose the children from the root to the
subroot, those of its rank in the group the children from there to the leaf. Each step joins the digests reached so far
with the records, takes the chosen child on, and appends the others to the path; a proof is the path in reverse. Requests
with a common path share its steps, so that the rows of a step are the nodes it reaches and not the leaves below.

At scale: the leaves alone are range-partitioned, by group, id and digest, with a number to part equal rows, so that a
group that holds a third of all rows is spread like any other. Ranks come from the place in the sorted partition and the
counts of earlier partitions. Tables of each height are written to the shared folder; their sizes shrink by ``FAN``.
Everything runs in DataFrame functions; the driver sees the root, the number of groups and the size of the largest one.

Cases: a null in any field is marked as such in the leaf; a null group is a group of its own and comes first; null ids come
first in their group; rows of the same id are ordered by leaf, and repeated rows are leaves of their own with equal
digests. Empty texts are fields of no bytes, long ones are digested whole. An empty table has a null root and no proofs.
Columns beside the fields play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import stage

#: Children of a node at most, and the bytes of a digest.
FAN, SIZE = 16, 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The bits of ``monotonically_increasing_id`` that number the rows of a partition (Spark's documented layout).
ROW_BITS = 33


def field_bytes(value: Column) -> Column:
    """A field as it enters the leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field_bytes(f) for f in fields]).cast("binary"), 256))


def hex_digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_digest(children: Column) -> Column:
    """The digest of a node, 32 bytes, from those of its children one after the other."""
    return F.unhex(F.sha2(hex_digits(children).cast("binary"), 256))


def heights(count: int) -> int:
    """Levels above so many nodes."""
    out = 0
    while count > 1:
        count = -(-count // FAN)
        out += 1
    return out


def sorted_rows(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written to the shared folder; ``_part`` and ``_row`` tell the places.

    Equal rows come in any order, and may lie in several partitions.
    """
    by = [*order, "_tie"]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return stage(placed, label).withColumn("_part", F.shiftright("_row", ROW_BITS))


def run_shifts(rows: DataFrame, within: list[str], label: str) -> DataFrame:
    """For each ``within`` group and partition: ``_shift``, to be added to ``_row`` for the rank in the group, and ``count``.

    There are few more such rows than the larger of both numbers.
    """
    runs = rows.groupBy(*within, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*within)
    earlier = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_shift", F.coalesce(earlier, F.lit(0)) - F.col("_first"))
    return stage(runs.select(*within, "_part", "_shift", F.sum("_n").over(group).alias("count")), label)


def raised(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """The levels above ``nodes`` (``grp, position, count, digest``), the lowest first: the same columns and ``children``.

    ``most`` is the largest ``count``. A group with one node left is not in the levels above.
    """
    out: list[DataFrame] = []
    for height in range(1, heights(most) + 1):
        runs = nodes.where("count > 1").groupBy("grp", F.expr(f"position div {FAN}").alias("position"))
        level = runs.agg(
            F.ceil(F.first("count") / F.lit(FAN)).alias("count"),
            F.sort_array(F.collect_list(F.struct("position", "digest"))).alias("_runs"),
        )
        joined = F.unhex(F.array_join(F.transform("_runs", lambda r: F.hex(r["digest"])), ""))
        level = level.select("grp", "position", "count", joined.alias("children"))
        nodes = stage(level.withColumn("digest", node_digest(F.col("children"))), f"{label}-{height}")
        out.append(nodes)
    return out


@dataclass
class Manifest:
    """``leaves``: ``grp, position, count, id, leaf`` and carried columns; ``groups``: ``grp, count, height, subroot`` and the
    group's own value; ``records`` and ``top_records``: ``digest, children`` for each height from 1 on; ``root``: one row, or none.
    """

    leaves: DataFrame
    groups: DataFrame
    records: list[DataFrame]
    top_records: list[DataFrame]
    root: DataFrame

    def store(self) -> DataFrame:
        """All records, ``digest`` to ``children``."""
        out = None
        for table in [*self.records, *self.top_records]:
            out = table if out is None else out.unionByName(table)
        return out.dropDuplicates(["digest"]) if out is not None else self.leaves.selectExpr("leaf digest", "leaf children").limit(0)


def _records(levels: list[DataFrame], label: str) -> list[DataFrame]:
    """The content-addressed records of each level; equal nodes are one record."""
    return [stage(x.select("digest", "children").dropDuplicates(["digest"]), f"{label}-{i}") for i, x in enumerate(levels, 1)]


def build(
    docs: DataFrame, fields: list[str] | None = None, id: str = "doc_id", group: str = "source",
    carry: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of ``docs``. ``carry`` names further expressions on ``docs`` to be kept with the leaves."""
    own = [F.col(f"`{c}`") for c in fields or FIELDS]
    leaves = docs.select(
        F.col(f"`{group}`").cast("string").alias("source"), F.col(f"`{id}`").alias("id"), leaf_digest(own).alias("leaf"),
        *[c.alias(f"carried_{name}") for name, c in (carry or {}).items()],
    )
    rows = sorted_rows(stage(leaves, "merkle-leaves"), ["source", "id", "leaf"], "merkle-sorted")
    runs = run_shifts(rows, ["source"], "merkle-runs")
    values = sorted_rows(runs.groupBy("source").agg(F.first("count").alias("rows")), ["source"], "merkle-values")
    groups = values.join(run_shifts(values, [], "merkle-value-runs"), "_part").select(
        F.col("source").alias("value"), "rows", (F.col("_row") + F.col("_shift")).alias("grp"), F.col("count").alias("groups")
    )
    groups = stage(groups, "merkle-groups")
    size = groups.agg(F.max("rows").alias("rows"), F.max("groups").alias("groups")).first()
    # the ranks of groups join the runs, not the rows, so that a large group is joined by its many partitions
    runs = runs.join(groups.select("value", "grp"), F.col("source").eqNullSafe(F.col("value"))).drop("value")
    runs = stage(runs.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), "_shift", "count", "grp"), "merkle-ranks")
    leaves = rows.join(runs, (F.col("_part") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_source")))
    carried = [f"carried_{name}" for name in carry or {}]
    leaves = leaves.select("grp", (F.col("_row") + F.col("_shift")).alias("position"), "count", "id", "leaf", *carried)

    levels = raised(leaves.select("grp", "position", "count", F.col("leaf").alias("digest")), size.rows or 0, "merkle-level")
    ends = [x.where("count = 1").select("grp", "digest", F.lit(h).alias("height")) for h, x in enumerate(levels, 1)]
    last = leaves.where("count = 1").select("grp", F.col("leaf").alias("digest"), F.lit(0).alias("height"))
    for end in ends:
        last = last.unionByName(end)
    groups = groups.join(last, "grp").select("grp", "value", F.col("rows").alias("count"), "height", F.col("digest").alias("subroot"))
    groups = stage(groups, "merkle-subroots")

    tops = groups.select(F.lit(0).alias("grp"), F.col("grp").alias("position"), F.lit(size.groups or 0).alias("count"), F.col("subroot").alias("digest"))
    above = raised(tops, size.groups or 0, "merkle-top")
    root = (above[-1] if above else tops).select(F.col("digest").alias("root"))
    return Manifest(leaves, groups, _records(levels, "merkle-records"), _records(above, "merkle-top-records"), root)


def _others(children: Column, digit: Column) -> Column:
    """A path segment: the children left and right of the chosen one."""
    begin = digit.cast("int") * SIZE
    return F.struct(
        F.substring(children, F.lit(1), begin).alias("left"),
        F.substring(children, begin + SIZE + 1, F.lit(FAN * SIZE)).alias("right"),
    )


def _step(reached: DataFrame, records: DataFrame, keep: list[str]) -> DataFrame:
    """From nodes (``grp, prefix, digest, path`` and ``keep``) to all their children."""
    with_children = reached.join(records, "digest")
    digits = F.explode(F.sequence(F.lit(0), (F.octet_length("children") / SIZE).cast("int") - 1))
    opened = with_children.select("*", digits.alias("digit"))
    return opened.select(
        "grp", *keep,
        (F.col("prefix") * FAN + F.col("digit")).alias("prefix"),
        F.substring("children", F.col("digit") * SIZE + 1, F.lit(SIZE)).alias("digest"),
        F.concat("path", F.array(_others(F.col("children"), F.col("digit")))).alias("path"),
    )


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves asked for, with ``subroot`` and ``path``: from the leaf up, the segments ``left`` and ``right`` of every level.

    ``requests`` has columns ``grp`` and ``position``; without it all leaves are asked for. A repeated request is answered once.
    """
    leaves = manifest.leaves
    if requests is not None:
        requests = stage(requests.select("grp", "position").distinct(), "merkle-requests")
        leaves = leaves.join(requests, ["grp", "position"], "left_semi")

    def wanted(reached: DataFrame, at: str, height: int) -> DataFrame:
        """The nodes above leaves that are asked for."""
        if requests is None:
            return reached
        span = FAN**height
        prefixes = requests.select(F.expr(f"{at} div {span}").alias("prefix"), *(["grp"] if at == "position" else []))
        return reached.join(prefixes.distinct(), ["prefix"] + ["grp"] * (at == "position"), "left_semi")

    segment = "array<struct<left: binary, right: binary>>"
    start = F.array().cast(segment).alias("path")
    reached = manifest.root.select(F.lit(0).alias("grp"), F.lit(0).cast("long").alias("prefix"), F.col("root").alias("digest"), start)
    for height in range(len(manifest.top_records), 0, -1):
        reached = wanted(_step(reached, manifest.top_records[height - 1], []), "grp", height - 1)
    tops = manifest.groups.join(reached.select(F.col("prefix").alias("grp"), "path"), "grp")
    if manifest.top_records:
        tops = stage(tops, "merkle-paths")

    down = None
    for height in range(len(manifest.records), 0, -1):
        fresh = tops.where(F.col("height") == height).select(
            "grp", "subroot", F.lit(0).cast("long").alias("prefix"), F.col("subroot").alias("digest"), "path"
        )
        down = fresh if down is None else down.unionByName(fresh)
        if height > 1:
            down = wanted(_step(down, manifest.records[height - 1], ["subroot"]), "position", height - 1)
    # the last step: a request joins the node above its leaf and leaves the path that far
    single = tops.where("height = 0").select("grp", "subroot", F.lit(0).cast("long").alias("prefix"), "path", F.lit(None).cast("binary").alias("children"))
    if down is not None:
        single = single.unionByName(down.join(manifest.records[0], "digest").drop("digest"))
    digit = F.col("position") % FAN
    own = F.when(F.col("children").isNull(), F.array().cast(segment)).otherwise(F.array(_others(F.col("children"), digit)))
    asked = leaves.withColumn("prefix", F.expr(f"position div {FAN}")).join(single, ["grp", "prefix"])
    return asked.withColumn("path", F.reverse(F.concat("path", own))).drop("prefix", "children")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give, in hex digits."""
    return F.aggregate(
        path, hex_digits(leaf),
        lambda node, s: F.sha2(F.concat(hex_digits(s["left"]), node, hex_digits(s["right"])).cast("binary"), 256),
    )


def proof_digest(path: Column) -> Column:
    """The SHA-256 of a proof's digests, level by level and left to right, in hex digits."""
    siblings = F.transform(path, lambda s: F.concat(hex_digits(s["left"]), hex_digits(s["right"])))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def verify(manifest: Manifest, claimed: str, requests: DataFrame | None = None) -> DataFrame:
    """Proofs checked against the root: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``claimed`` names the carried leaf that is folded, in place of the stored one.
    """
    root = manifest.root.first()
    trusted = F.lit(root.root.hex() if root else None).cast("string")
    out = prove(manifest, requests).select(
        "id", hex_digits(F.col("leaf")).alias("leaf"), hex_digits(F.col("subroot")).alias("subroot"),
        trusted.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col(f"carried_{claimed}"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
