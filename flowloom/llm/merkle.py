"""A Merkle manifest of a dataset, folded from retained SHA-256 states.

The rows of a source, in the order of their keys, are the leaves of its tree; each run of
16 consecutive nodes becomes their parent, a hash of their digests as hex text. The roots
of the sources are the leaves of one more tree.

A parent is hashed child by child, and a copy of the hash state is retained before each
child's slot. To fold a changed child the copy of its slot is resumed with the replacement
and the siblings to its right; what is left of it is never hashed again.

At scale: leaf digests are made where the rows are read, and only keys and digests are
sorted. Blocks of 4096 leaves (three levels) go to a task each, once to make the digest on
top of every block, which are the leaves of the next table, 4096 times smaller, until each
tree has one node; and once, together with the block's path to the root, to fold. A path
holds siblings only, and the states of its slots are made once for a block and resumed for
all its rows. So no task holds more than a block, whatever a source holds.

Defined results: a null field is hashed as '-'. A null source sorts first, as does a null key;
rows of equal keys sort by their leaf, and rows that repeat are leaves each. A tree of one
leaf is that leaf. An empty table gives no rows and has no root. Long texts are hashed whole.
Columns that are not named do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.batches import quoted
from flowloom.operators.ordering import carried, group_key, numbered, sorted_table
from flowloom.session import forget, keep, ship_package

#: Children of a node, and levels and leaves of a block.
FAN = 16
LEVELS = 3
BLOCK = FAN**LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of all fields, each as its length in bytes, a colon and its value, or '-'."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


class Parent:
    """A node over up to FAN child digests, with the state before each child's slot."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]) -> None:
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, digest: bytes) -> bytes:
        """The node's digest if the child at ``slot`` had this one."""
        state = self.states[slot].copy()
        state.update(digest + b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()


class Step:
    """A node that is known by the siblings of one child: only that slot's state is retained."""

    __slots__ = ("left", "right", "state")

    def __init__(self, left: bytes, right: bytes) -> None:
        self.left, self.right = left, right
        self.state = hashlib.sha256(left)

    def folded(self, digest: bytes) -> bytes:
        state = self.state.copy()
        state.update(digest + self.right)
        return state.hexdigest().encode()


def grow(leaves: list[bytes], nodes: int) -> list[list[Parent]]:
    """The levels above the leaves of a block; ``nodes`` are those of the whole tree beside them."""
    levels: list[list[Parent]] = []
    row = leaves
    for _ in range(LEVELS):
        if nodes == 1:
            break
        parents = [Parent(row[i : i + FAN]) for i in range(0, len(row), FAN)]
        levels.append(parents)
        row, nodes = [p.digest for p in parents], -(-nodes // FAN)
    return levels


def path(levels: list[list[Parent]], at: int) -> Iterator[tuple[bytes, bytes]]:
    """The siblings to the left and right of leaf ``at``'s path, level by level."""
    for parents in levels:
        children = parents[at // FAN].children
        yield b"".join(children[: at % FAN]), b"".join(children[at % FAN + 1 :])
        at //= FAN


def _block_of(table: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    table = table.sort_by("pos")
    return table, table.column("digest").cast(pa.binary()).to_pylist(), table.column("nodes")[0].as_py()


def _tops(table: pa.Table) -> pa.Table:
    """The digest on top of one block of (tree, block, pos, digest, nodes)."""
    table, leaves, nodes = _block_of(table)
    levels = grow(leaves, nodes)
    top = levels[-1][0].digest if levels else leaves[0]
    row = {"tree": table.column("tree")[0].as_py(), "pos": table.column("block")[0].as_py(), "digest": top.decode(), "nodes": -(-nodes // BLOCK)}
    return pa.Table.from_pylist([row], _NODES)


_NODES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("nodes", pa.int64())])
_STEPS = "array<struct<left:binary,right:binary>>"
_STEP_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _steps(table: pa.Table) -> pa.Table:
    """The steps of each node of one block inside the block."""
    table, leaves, nodes = _block_of(table)
    levels = grow(leaves, nodes)
    found = [[{"left": a, "right": b} for a, b in path(levels, i)] for i in range(len(leaves))]
    return pa.table([table.column("tree"), table.column("pos"), table.column("block"), pa.array(found, _STEP_TYPE)], names=["tree", "pos", "block", "steps"])


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, paths) of many trees, from a kept table (tree, pos, digest, nodes) with the number
    of nodes of each tree: (tree, root), and for each block of leaves (tree, block, steps), its
    steps from the digest on top of it to the root."""
    stages = [leaves]
    while True:
        grouped = _in_blocks(stages[-1]).groupBy("tree", "block")
        above = keep(grouped.applyInArrow(_tops, "tree string, pos long, digest string, nodes long"), "nodes")
        stages.append(above)
        if not above.where("nodes > 1").limit(1).count():
            break
    roots = stages[-1].select("tree", F.col("digest").alias("root"))
    paths = stages[-1].select("tree", "pos", F.array().cast(_STEPS).alias("steps"))
    for stage in reversed(stages[1:-1]):
        own = _in_blocks(stage).groupBy("tree", "block").applyInArrow(_steps, f"tree string, pos long, block long, steps {_STEPS}")
        above = paths.select("tree", F.col("pos").alias("block"), F.col("steps").alias("above"))
        paths = own.join(above, ["tree", "block"]).select("tree", "pos", F.concat("steps", "above").alias("steps"))
    return roots, paths.withColumnRenamed("pos", "block")


def _fold(kept: list[str]):
    """Proofs and folded roots of one block's rows, given the path above the block."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, leaves, nodes = _block_of(rows)
        levels = grow(leaves, nodes)
        upper = [Step(s["left"], s["right"]) for s in above.column("steps")[0].as_py()]
        rest = b"".join(s.left + s.right for s in upper)
        top = levels[-1][0].digest if levels else leaves[0]
        root = _climb(top, upper)
        changed = rows.column("changed").cast(pa.binary()).to_pylist()
        proofs, folded = [], []
        for at, other in enumerate(changed):
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path(levels, at)) + rest).hexdigest())
            if other is None or other == leaves[at]:
                folded.append(root.decode())
                continue
            digest, place = other, at
            for parents in levels:
                digest, place = parents[place // FAN].folded(place % FAN, digest), place // FAN
            folded.append(_climb(digest, upper).decode())
        same = [pa.array([x] * len(leaves)) for x in (above.column("subroot")[0].as_py(), root.decode())]
        return pa.table([*[rows.column(c) for c in kept], *same, pa.array(proofs), pa.array(folded)], names=[*kept, "subroot", "root", "proof_sha256", "folded_root"])

    return run


def _climb(digest: bytes, steps: Iterable[Step]) -> bytes:
    for step in steps:
        digest = step.folded(digest)
    return digest


def manifest(df: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, changes: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``df``: key, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``changes`` replaces fields (by name) in a second leaf; folded_root is what the root would be
    with it, from the row's siblings alone, and verified says whether that is the root.
    """
    ship_package(df.sparkSession)
    own = {c: F.col(quoted(c)) for c in fields}
    leaf = leaf_digest(list(own.values()))
    other = leaf_digest(list((own | changes).values())) if changes else F.lit(None).cast("string")
    read = df.select(F.col(quoted(key)).alias("key"), group_key(F.col(quoted(source))).alias("tree"), leaf.alias("digest"), other.alias("changed"))
    # the rows of a source may fill many ranges: a row's place is its place in the range and the source's rows before
    ranges = sorted_table(read, ["tree", F.col("key").asc_nulls_first(), "digest"], "leaves")
    sums = carried(ranges.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("row").alias("first")), "n", "before", ["tree"])
    sizes = sums.groupBy("tree").agg(F.sum("n").alias("nodes"))
    offsets = sums.join(sizes, "tree").select("tree", "range", (F.col("before") - F.col("first")).alias("offset"), "nodes")
    leaves = keep(ranges.join(offsets, ["tree", "range"]).select("key", "tree", "digest", "changed", (F.col("row") + F.col("offset")).alias("pos"), "nodes"), "placed")
    forget(ranges)

    subroots, inside = forest(leaves.select("tree", "pos", "digest", "nodes"))
    placed, ordered = numbered(subroots, ["tree"], "pos", "subroots")
    sources = placed.withColumn("nodes", F.lit(ordered.count()).cast("long"))
    tops = keep(sources.select(F.lit("").alias("tree"), "pos", F.col("root").alias("digest"), "nodes", F.col("tree").alias("source")), "sources")
    _, beyond = forest(tops.select("tree", "pos", "digest", "nodes"))
    last = _in_blocks(tops).groupBy("tree", "block").applyInArrow(_steps, f"tree string, pos long, block long, steps {_STEPS}")
    last = last.join(beyond.withColumnRenamed("steps", "above"), ["tree", "block"]).select("pos", F.concat("steps", "above").alias("above"))
    of_source = tops.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "pos").join(last, "pos").drop("pos")
    paths = inside.join(of_source, "tree").select("tree", "block", "subroot", F.concat("steps", "above").alias("steps"))

    names = ["key", "digest"]
    kind = leaves.schema["key"].dataType.simpleString()
    folded = _in_blocks(leaves).groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(_fold(names), f"key {kind}, digest string, subroot string, root string, proof_sha256 string, folded_root string")
    return folded.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z in lower case where 5 divides the key's CRC-32, else as it is."""
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(F.col(text))


def _sql_levels(name: str, leaves: str, depth: int) -> str:
    """Common tables that raise the nodes of ``leaves`` (tree, pos, n, digest) and chains of rows
    ({name}_c0: uid, tree, pos, n, cur, proof) by ``depth`` levels."""
    text = f"{name}_0 as ({leaves})"
    for k in range(1, depth + 1):
        text += f""",
{name}_g{k} as (select tree, pos // 16 as g, list(digest order by pos) as kids from {name}_{k - 1} where n > 1 group by all),
{name}_{k} as (select tree, pos, n, digest from {name}_{k - 1} where n = 1
  union all select g.tree, g.g, (m.n + 15) // 16, sha256(array_to_string(kids, '')) from {name}_g{k} g join (select distinct tree, n from {name}_{k - 1}) m using (tree)),
{name}_c{k} as (select uid, c.tree, case when kids is null then pos else pos // 16 end as pos, case when kids is null then n else (n + 15) // 16 end as n,
  case when kids is null then cur else sha256(array_to_string(list_concat(list_concat(kids[1:pos % 16], [cur]), kids[pos % 16 + 2:]), '')) end as cur,
  case when kids is null then proof else proof || array_to_string(list_concat(kids[1:pos % 16], kids[pos % 16 + 2:]), '') end as proof
  from {name}_c{k - 1} c left join {name}_g{k} g on c.tree = g.tree and c.pos // 16 = g.g and c.n > 1)"""
    return text


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in (*FIELDS[:-1], text)) + ")"


_SQL_CRC = "list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
_SQL_DEPTH = 5, 3

#: The same manifest in SQL, for up to 16^5 rows of a source and 16^3 sources.
ORACLE = f"""
with docs as (
  select row_number() over () as uid, doc_id, coalesce('=' || source, '') as tree, {_sql_leaf("text")} as leaf,
         case when xor({_SQL_CRC}, 4294967295) % 5 = 0 then {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as changed
  from documents),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from docs),
a_c0 as (select uid, tree, pos, n, coalesce(changed, leaf) as cur, '' as proof from placed),
{_sql_levels("a", "select tree, pos, n, leaf as digest from placed", _SQL_DEPTH[0])},
subroots as (select tree, digest as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from a_{_SQL_DEPTH[0]}),
b_c0 as (select uid, 'all' as tree, s.pos, s.n, cur, proof from a_c{_SQL_DEPTH[0]} c join subroots s using (tree)),
{_sql_levels("b", "select 'all' as tree, pos, n, subroot as digest from subroots", _SQL_DEPTH[1])}
select d.doc_id, d.leaf, s.subroot, r.digest as root, sha256(c.proof) as proof_sha256, c.cur as folded_root, c.cur = r.digest as verified
from docs d join subroots s using (tree) join b_c{_SQL_DEPTH[1]} c using (uid), b_{_SQL_DEPTH[1]} r
"""
