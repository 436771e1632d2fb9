"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find by contraction.

1. Every text gives its set size, a 128-bit digest of its set, and the hashes of its bands. Texts with equal sets are
   one class with a number, of which one row goes on (smallest id, then hash of the text): copies, however many, are
   never paired.
2. Classes that share a band are candidates. Each is compared with the first of its bucket; those links are contracted
   to groups.
3. A bucket whose members are of one group is done. In the others, members outside the largest group are compared
   with all members of other groups, inside tasks and in blocks of ``BLOCK`` members, so no pair becomes a row unless
   it is a link. Pairs that share several bands are compared once. Sets are compared whole; an estimate from the
   signatures is not used.
4. The links of both rounds are contracted again.

With ``BANDS`` bands of ``ROWS`` rows a pair of similarity 0.8 shares no band with a probability below 7e-6.

A text without words has an empty set, is linked with nothing and is its own component. Rows that repeat an id with
different texts are compared each with its own text, and ``component_id`` is the smallest id among the rows that a row
reaches; rows with a null id link like others and give a component its name only if all its ids are null. ``chosen``
marks one (``doc_id``, ``text_key``) of every component, the smallest id, then hash of the text; rows that repeat both
are marked alike, and so is every row without words. Every input row gives one output row. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stage
from . import shingles as S
from .common import map_arrow
from .components import connected_components

WIDTH = 4
PERCENT = 80
BANDS, ROWS = 30, 5
#: Members of a bucket that are compared in one unit.
BLOCK = 1024
#: Matches texts with at least one word.
HAS_WORD = r"[^\x20\x09-\x0D]"
DIGEST_SALT = np.uint64(0x5851F42D4C957F2D)


def _sets(texts: pa.Array, width: int):
    """Slices of a batch: first and last text, their shingles, and where each text's begin."""
    flat, offsets = S.text_bytes(texts)
    for a, b in S.slices(offsets):
        words, firsts = S.word_hashes(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *S.shingle_sets(words, firsts, width)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def signatures(docs: DataFrame, id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, the digest (``low``, ``high``) and ``bands`` of every row."""
    body = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("d"), body.alias("t"), F.xxhash64(body).alias("k"))

    def run(batch: pa.RecordBatch):
        for a, b, elements, ends in _sets(batch.column(1), width):
            hashes = S.band_hashes(S.super_minhash(elements, ends, bands * rows), bands).view(np.int64)
            offsets = pa.array(np.arange(0, bands * (b - a) + 1, bands, dtype=np.int32))
            yield {
                "doc_id": batch.column(0).slice(a, b - a),
                "text_key": batch.column(2).slice(a, b - a),
                "n_shingles": pa.array(np.diff(ends)),
                "low": pa.array(_sums(S.mix(elements), ends)),
                "high": pa.array(_sums(S.mix(elements ^ DIGEST_SALT), ends)),
                "bands": pa.ListArray.from_arrays(offsets, pa.array(hashes.reshape(-1))),
            }

    schema = "doc_id bigint, text_key bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>"
    return map_arrow(source, run, schema)


def _verify_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough."""
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    ).select("a", "b", "ta", "tb")

    def run(batch: pa.RecordBatch):
        sides = []
        for c in (2, 3):
            own: list[np.ndarray] = []
            for _, _, elements, ends in _sets(batch.column(c), width):
                own += [elements[p:q] for p, q in zip(ends[:-1].tolist(), ends[1:].tolist())]
            sides.append(own)
        keep = pa.array([S.jaccard_at_least(x, y, percent) for x, y in zip(*sides)], pa.bool_())
        yield {c: batch.column(i).filter(keep) for i, c in enumerate("ab")}

    return map_arrow(rows, run, "a bigint, b bigint")


def _compare_unit(table: pa.Table, width: int, percent: int) -> pa.Table:
    """The links of a unit: ``node``, ``label``, ``role`` (0 member, 1 probe), ``bands`` and ``text`` of its rows."""
    table = table.sort_by([("role", "ascending"), ("node", "ascending")])
    role = table["role"].to_numpy()
    ids, labels = table["node"].to_numpy(), table["label"].to_numpy()
    stray, place = table["stray"].to_numpy(), table["band"].to_numpy()
    sets: list[np.ndarray] = []
    for chunk in table["text"].chunks:
        for _, _, elements, ends in _sets(chunk, width):
            sets += [elements[p:q] for p, q in zip(ends[:-1].tolist(), ends[1:].tolist())]
    bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(ids), -1)
    sizes = np.array([len(s) for s in sets])
    members, probes = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    # every element of the members, by value: one look-up gives a probe's intersections with all of them
    elements = np.concatenate([sets[i] for i in members]) if len(members) else np.zeros(0, np.uint64)
    holder = np.repeat(np.arange(len(members)), sizes[members])
    order = np.argsort(elements, kind="stable")
    elements, holder = elements[order], holder[order]
    found_a, found_b = [], []
    for p in probes.tolist():
        low = np.searchsorted(elements, sets[p], "left")
        count = np.searchsorted(elements, sets[p], "right") - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        both = np.bincount(holder[at], minlength=len(members))
        union = sizes[members] + sizes[p] - both
        ok = (100 * both >= percent * union) & (labels[members] != labels[p])
        ok &= ~stray[members] | (ids[members] < ids[p])  # two strays meet twice
        for m in members[ok].tolist():
            # only in the first band that the two share
            if int((bands[m] == bands[p]).argmax()) == place[p]:
                found_a.append(int(ids[m]))
                found_b.append(int(ids[p]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _compare_buckets(
    members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame:
    """The links between members of different groups that share a bucket."""
    known = members.select("bucket", "band", "node").join(labels, "node", "left")
    known = stage(known.withColumn("label", F.coalesce("component", "node")).drop("component"), "members")
    groups = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = (
        groups.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max(F.struct("n", "label")).alias("top"))
        .where("groups > 1")
        .select(
            "bucket", F.col("top.label").alias("top"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("parts"),
        )
    )
    rows = known.join(mixed, "bucket").withColumn("stray", F.col("label") != F.col("top"))
    place = F.xxhash64("node")
    block = F.pmod(place, F.col("blocks")).cast("int")
    part = F.pmod(F.shiftright(place, 20), F.col("parts")).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    as_member = rows.select("*", F.lit(0).alias("role"), block.alias("block"), up_to(F.col("parts")).alias("part"))
    as_probe = rows.where("stray").select("*", F.lit(1).alias("role"), part.alias("part"), up_to(F.col("blocks")).alias("block"))
    units = as_member.unionByName(as_probe).select("bucket", "band", "block", "part", "node", "label", "stray", "role")
    filled = units.join(nodes.select("node", "bands"), "node").join(texts, "node")
    return filled.groupBy("bucket", "block", "part").applyInArrow(
        lambda table: _compare_unit(table, width, percent), "a bigint, b bigint"
    )


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``component_id`` (smallest reachable id), ``kept`` and ``chosen`` for every
    row of ``docs``."""
    if bands * rows > 65_536:
        raise ValueError("a signature has at most 65,536 places")
    found = stage(signatures(docs, id, text, width, bands, rows), "signatures")
    full = found.where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    firsts = full.groupBy("low", "high", "n_shingles").agg(F.min(place).alias("first"))
    classes = stage(
        firsts.select(
            F.monotonically_increasing_id().alias("node"), "low", "high",
            F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"),
        ), "classes"
    )
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
    same_class = (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
    named = classes.withColumnsRenamed({"low": "l", "high": "h"})
    nodes = full.join(named, same_class & is_rep).select("node", "bands").dropDuplicates(["node"])
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = stage(placed.join(buckets, "bucket"), "buckets")

    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sought = members.select("node").distinct().join(classes.select("node", "rep", "rep_key"), "node")
    body = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    texts = stage(source.join(sought, is_rep).select("node", "text").dropDuplicates(["node"]), "texts")
    links = stage(_verify_pairs(pairs, texts, width, percent), "links")
    more = stage(_compare_buckets(members, connected_components(links), nodes, texts, width, percent), "links")
    linked = stage(classes.join(connected_components(links.unionByName(more)), "node"), "linked")

    first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "rep_key"))
    heads = linked.groupBy("component").agg(first.alias("head"))
    linked = linked.join(heads, "component").select("node", "head")
    own = F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "rep_key")
    heads = classes.join(linked, "node", "left").select("low", "high", F.coalesce("head", own).alias("head"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.rep")) & (F.col("text_key") == F.col("head.rep_key"))
    component = F.coalesce("head.rep", "doc_id")
    return found.join(heads, ["low", "high"], "left").select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), (F.col("head").isNull() | is_head).alias("chosen"),
    )
