import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from barspark.llm import merkle as M
from barspark.llm.queries import QUERIES

from .llm_samples import AWKWARD

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def brute(rows):
    """The rows of the query, each proof by a walk from the leaf up."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, siblings = leaf(r[:4] + (lowered(r[4]),)) if tampered else own, []
            for levels, p in ((trees[g], i), (top, at)):
                for level in levels[:-1]:
                    first = p // 16 * 16
                    left, right = level[first:p], level[p + 1 : first + 16]
                    siblings += left + right
                    node = digest("".join([*left, node, *right]))
                    p //= 16
            root = top[-1][0]
            out.append((r[0], own, trees[g][-1][0], root, digest("".join(siblings)), node, node == root))
    return out


def table(spark, rows):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, path string, grp int"
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], schema)


def sample(count, seed):
    rng = random.Random(seed)
    sources = [None, "", "é", "z", "Z", *[f"s{i}" for i in range(20)]]
    rows = []
    for i in range(count):
        source = "hot" if rng.random() < 0.35 else rng.choice(sources)
        text = rng.choice([None, "", "Ab Ç é", f"Text {i} ÀB", f"lower {i}"])
        rows.append((rng.choice([None, i, i, i, i // 2]), source, rng.choice([None, "en"]), rng.choice([None, 0, i]), text))
    return rows + [(None, "same", None, None, "A")] * 40


@pytest.mark.parametrize("rows", [sample(700, 1), [(1, None, None, None, None)], [(i, "one", "en", 1, "X") for i in range(17)]])
def test_query_equals_brute_force(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_merkle"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_records_lead_from_the_root_to_every_leaf(spark):
    rows = sample(300, 2)
    manifest = M.build(table(spark, rows))
    store = {bytes(r.digest): bytes(r.children) for r in manifest.store().collect()}
    for parent, children in store.items():
        assert hashlib.sha256(children.hex().encode()).digest() == parent

    reached, todo = [], [bytes(manifest.root.first().root)]
    leaves = {leaf(r) for r in rows}
    while todo:
        node = todo.pop()
        if node.hex() in leaves:
            reached.append(node.hex())
        else:
            todo += [store[node][i : i + 32] for i in range(0, len(store[node]), 32)]
    assert sorted(reached) == sorted(map(leaf, rows))


def test_single_requests(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"t{i}") for i in range(600)]
    manifest = M.build(table(spark, rows), carry={"own": M.leaf_digest([F.col(c) for c in FIELDS])})
    asked = manifest.leaves.where("id in (0, 7, 31, 598)").select("grp", "position")
    got = M.verify(manifest, "own", asked.unionByName(asked)).collect()
    assert sorted(r.id for r in got) == [0, 7, 31, 598] and all(r.verified for r in got)
    everything = {r.id: r.proof_sha256 for r in M.verify(manifest, "own").collect()}
    assert len(everything) == 600 and all(everything[r.id] == r.proof_sha256 for r in got)
    assert M.verify(manifest, "own", asked.limit(0)).count() == 0


def test_awkward_and_empty(awkward, empty):
    manifest = M.build(awkward, carry={"own": M.leaf_digest([F.col(c) for c in FIELDS])})
    got = M.verify(manifest, "own").collect()
    assert len(got) == len(AWKWARD) and all(r.verified for r in got)
    nothing = M.build(empty, carry={"own": M.leaf_digest([F.col(c) for c in FIELDS])})
    assert M.verify(nothing, "own").count() == 0 and nothing.root.count() == 0 and nothing.store().count() == 0
