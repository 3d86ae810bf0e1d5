"""MinHash near-dedup by an inverted join on signature coordinates, confirmed on full shingle sets.

1. A document's set is its distinct ``WIDTH``-word shingles; its signature is ``COORDINATES``
   least hashes. Documents with equal sets become one node.
2. Nodes are posted under each (coordinate, value). A pair must collide in ``MATCHES``
   coordinates at least, so it meets inside the ``COORDINATES - MATCHES + 1`` rarest postings
   of both (prefix); the frequent postings, which are the long lists, are never merged (skip).
   For a pair at the threshold the collisions are binomial (32, 0.85): fewer than 16 happen
   about once in two million pairs.
3. Lists are merged in steps, not by all pairs of a list. First the list's hub, the member with
   the most collisions in all its lists, meets every member, and links are joined to components.
   Where many members of a hub's lists are not joined with it, they elect a hub of their own, as
   long as a tenth of them links to it. Then only members of different components meet, by their
   differences from the hub: with c = (1 - s) / (1 + s), sets of similarity s or more differ in
   c * (n + n') shingles at most, and if x and y differ from the hub in dx and dy shingles, they
   differ in dx + dy less twice the differences they share. Of two members of different
   components one is not linked to the hub, so dx + dy is over the bound and a link needs shared
   differences: the two meet in the least frequent of them (prefix) and only where the positions
   leave enough to share. So what all copies have in common is never merged, and no pair that
   could be a link is left out. Pairs that pass need ``MATCHES`` collisions and are confirmed by
   the exact intersection.
4. Components come from alternating large-star and small-star steps over the links.

Nulls and empties: a null or blank text has the empty set, is linked with nothing and is its
own component. A row without doc_id takes part, but names no component: a component without
any doc_id has component_id null and kept false. Equal rows are one node, as are rows that
share a doc_id. An empty table gives an empty result. ``one_of_each_group`` goes by sets instead
of doc_ids: copies without doc_id leave one row, and unlike texts of one doc_id are not linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm.common import Scratch, byte_slices, mixed, shingle_hashes, table, word_hashes

WIDTH = 5
COORDINATES = 32
MATCHES = 16
PERCENT = 85
CROWDED = 32  # members of a hub's lists not joined with it from which they elect another hub
NAMELESS = 1 << 62  # nodes without any doc_id are numbered from here

_MULTIPLY = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function, with the coordinate's number in the low bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k:k + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    low = np.uint64(COORDINATES - 1)
    return ((least & ~low) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def shingle_sets(values: list[bytes]) -> Iterator[np.ndarray]:
    words, starts = word_hashes(values)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield np.unique(shingle_hashes(words[a:b], WIDTH))


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, values in byte_slices(batch.column("n_text")):
            counts, digests, signatures = [], [], []
            for shingles in shingle_sets(values):
                counts.append(len(shingles))
                digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
                signatures.append(signature(shingles) if len(shingles) else None)
            pair = np.array(digests).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("n_id").slice(first, end - first), batch.column("n_hash").slice(first, end - first), pa.array(counts, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                 pa.array(signatures, pa.list_(pa.int64()))], names=["n_id", "n_hash", "n_shingles", "n_d1", "n_d2", "n_sig"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, values in byte_slices(batch.column("n_text")):
            sets = pa.array([s.view(np.int64) for s in shingle_sets(values)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, end - first), sets], names=["node", "members"])


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other node, which itself points nowhere."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    return ends.groupBy("x").agg(F.sum("from").alias("from"), F.max("to").alias("to")).where("from > 1 OR (from = 1 AND to = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) to (node, comp): the least node that each node reaches; nodes that are least are left out."""
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _all_stars(edges):
        # large star: larger neighbours go to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step = scratch.keep(small)
        scratch.drop(edges)
        edges = step
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _side(frame: DataFrame, end: str, *values: str) -> DataFrame:
    return frame.select(F.col("node").alias(end), *[F.col(v).alias(f"{v}_{end}") for v in values])


def _with_common(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of both sets, n_a and n_b, and of their intersection."""
    pairs = pairs.join(_side(members, "a", "members"), "a").join(_side(members, "b", "members"), "b")
    return pairs.select("a", "b", F.size("members_a").alias("n_a"), F.size("members_b").alias("n_b"), F.size(F.array_intersect("members_a", "members_b")).alias("common"))


def _similar(common: Column, n_a: Column, n_b: Column) -> Column:
    return common * 100 >= (n_a + n_b - common) * PERCENT


def _may_be_similar(n_a: Column, n_b: Column, differ: Column) -> Column:
    """Whether sets of these sizes that differ in so many members at least can be similar enough."""
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT) & (differ * (100 + PERCENT) <= (n_a + n_b) * (100 - PERCENT))


def _with_comps(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """``groups`` with the components of the hub and of the node."""
    of_hub = comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    groups = groups.join(comps, "node", "left").join(of_hub, "hub", "left")
    return groups.withColumn("comp", F.coalesce("comp", "node")).withColumn("hub_comp", F.coalesce("hub_comp", "hub"))


def _further_hubs(groups: DataFrame, comps: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after crowds of members that are not joined with their hub have met hubs of their own."""
    open_ = scratch.keep(_with_comps(groups, comps).where("comp <> hub_comp").select("hub", "node", "seen"))
    while True:
        heads = open_.groupBy("hub").agg(F.count("*").alias("held"), F.min(F.struct((-F.col("seen")).alias("seen"), "node")).alias("h"))
        heads = scratch.keep(heads.where(F.col("held") > CROWDED).select("hub", F.col("h.node").alias("head")))
        if heads.isEmpty():
            return comps
        turn = open_.join(heads, "hub").where("node <> head")
        met = _with_common(turn.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), members)
        links = scratch.keep(met.where(_similar(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b"))
        if links.isEmpty():
            return comps
        won = turn.join(links.select(F.col("a").alias("head"), F.col("b").alias("node"), F.lit(1).alias("won")), ["head", "node"], "left").select("hub", "node", "seen", F.coalesce("won", F.lit(0)).alias("won"))
        won = scratch.keep(won)
        goes_on = won.groupBy("hub").agg(F.sum("won").alias("links"), F.count("*").alias("held")).where("links * 10 >= held").select("hub")
        open_ = scratch.keep(won.where("won = 0").join(goes_on, "hub").select("hub", "node", "seen"))
        comps = components(links.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))), scratch)


def _differences(groups: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, shingle, main, node, n, d, comp, place): the differences from the hub in which a node may meet others.

    Differences go from the least to the most frequent of their hub; ``place`` counts them from 0 and
    ``main`` is the component that most nodes with this difference belong to.
    """
    both = groups.join(members.withColumnsRenamed({"node": "hub", "members": "of_hub"}), "hub").join(members, "node")
    apart = F.concat(F.array_except("members", "of_hub"), F.array_except("of_hub", "members"))
    each = scratch.keep(both.select("hub", "node", "comp", F.explode(apart).alias("shingle")))
    counts = each.groupBy("hub", "shingle", "comp").agg(F.count("*").alias("f"))
    counts = counts.groupBy("hub", "shingle").agg(F.max(F.struct("f", "comp")).alias("m"), F.sum("f").alias("f"), F.count("*").alias("comps")).where("f > 1")
    counts = counts.select("hub", "shingle", "f", F.when(F.col("comps") > 1, F.col("m.comp")).alias("main"))
    held = each.join(counts, ["hub", "shingle"], "left").groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "shingle", "main"))).alias("held"))
    # a link of a node near the hub is to one that is not; any other node shares all but T differences with its partner
    near = F.expr(f"(d * {100 + PERCENT} + (n - n_hub) * {100 - PERCENT}) div {2 * (100 + PERCENT)}")
    prefix = F.when(F.col("near"), near).otherwise(F.expr(f"n * {100 - PERCENT} div {PERCENT}")) + 1
    held = held.join(groups, ["hub", "node"]).select("hub", "node", "n", "d", "comp", F.posexplode(F.slice("held", F.lit(1), prefix.cast("int"))).alias("place", "h"))
    return scratch.keep(held.where("h.main IS NOT NULL").select("hub", "h.shingle", "h.main", "node", "n", "d", "comp", "place"))


def _links(lists: DataFrame, sets: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of the nodes that are not the least of their component."""
    hubs = lists.groupBy("key").agg(F.count("*").alias("held"), F.min(F.struct((-F.col("seen")).alias("seen"), "node")).alias("h")).where("held > 1")
    stars = scratch.keep(lists.join(hubs.select("key", F.col("h.node").alias("hub")), "key").where("node <> hub").select("hub", "node", "seen").distinct())
    met = scratch.keep(_with_common(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")), members))
    near = _similar(F.col("common"), F.col("n_a"), F.col("n_b"))
    comps = components(met.where(near).select("a", "b"), scratch)
    groups = met.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("n_b").alias("n"), F.col("n_a").alias("n_hub"), (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("d"), near.alias("near"))
    comps = _further_hubs(stars, comps, members, scratch)

    rest = scratch.keep(_with_comps(groups, comps).drop("hub_comp"))
    several = rest.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("hub")
    shared = _differences(rest.join(several, "hub"), members, scratch)
    # of two members of different components one at least is not of the main one
    left, right = (shared.select("hub", "shingle", *[F.col(c).alias(f"{c}_{e}") for c in ("main", "node", "n", "d", "comp", "place")]) for e in ("a", "b"))
    once = (F.col("comp_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    in_common = F.least(F.col("d_a") - F.col("place_a"), F.col("d_b") - F.col("place_b"))  # if this is the first they share
    differ = F.col("d_a") + F.col("d_b") - 2 * in_common
    pairs = left.where("comp_a <> main_a").join(right, ["hub", "shingle"]).where((F.col("comp_a") != F.col("comp_b")) & once & _may_be_similar(F.col("n_a"), F.col("n_b"), differ))
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    # values carry their coordinate, so their intersection counts collisions
    signed = pairs.join(_side(sets, "a", "n_sig"), "a").join(_side(sets, "b", "n_sig"), "b")
    pairs = signed.where(F.size(F.array_intersect("n_sig_a", "n_sig_b")) >= MATCHES).select("a", "b")
    more = scratch.keep(_with_common(pairs, members).where(_similar(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b"))
    if more.isEmpty():
        return comps
    return components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))), scratch)


def _grouped(docs: DataFrame, scratch: Scratch, node: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a set, and the others with the least node of their component; ``node`` numbers a set, as an aggregate of its rows."""
    keyed = docs.select(F.col("doc_id").alias("n_id"), F.xxhash64("text").alias("n_hash"), F.col("text").alias("n_text"))
    rows = scratch.keep(keyed.mapInArrow(_signature_rows, "n_id bigint, n_hash bigint, n_shingles bigint, n_d1 bigint, n_d2 bigint, n_sig array<bigint>"))
    sets = rows.where("n_shingles > 0").groupBy("n_d1", "n_d2").agg(
        node.alias("node"), F.min(F.struct("n_id", "n_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("n_sig").alias("n_sig"))
    sets = scratch.keep(sets)
    postings = sets.select("node", F.explode("n_sig").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = postings.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"), F.sum("n").alias("seen"))
    ranked = ranked.where(F.size("held") >= MATCHES)
    lists = ranked.select("node", "seen", F.explode(F.slice("held", F.lit(1), F.size("held") - (MATCHES - 1))).alias("p")).select("node", "seen", "p.key")
    lists = scratch.keep(lists)
    wanted = sets.join(lists.select("node").distinct(), "node", "left_semi").select("node", "one.*")
    text = keyed.join(wanted.withColumnsRenamed({"n_id": "w_id", "n_hash": "w_hash"}), [F.col("n_id").eqNullSafe(F.col("w_id")), F.col("n_hash") == F.col("w_hash")])
    members = scratch.keep(text.select("node", "n_text").mapInArrow(_set_rows, "node bigint, members array<bigint>"))

    comps = _links(lists, sets, members, scratch)
    named = rows.where("n_shingles > 0").join(sets.select("n_d1", "n_d2", "node"), ["n_d1", "n_d2"]).select("n_id", "n_hash", "n_shingles", "node")
    return rows.where("n_shingles = 0"), named.join(comps, "node", "left").withColumn("node", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    node = F.coalesce(F.min("n_id"), F.first("n_d1").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    bare, named = _grouped(docs, scratch, node)
    named = named.select("n_id", "n_shingles", F.when(F.col("node") < NAMELESS, F.col("node")).alias("component_id"))
    bare = bare.select("n_id", "n_shingles", F.col("n_id").alias("component_id"))
    return named.unionByName(bare).select(
        F.col("n_id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("n_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of sets, whatever the doc_ids: the one of least doc_id, without any of least text hash.

    Rows that share a doc_id are linked by their texts only. Rows without words have no copies but
    equal ones of their doc_id; without a doc_id all of them stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    bare, named = _grouped(docs, scratch, F.first("n_d1"))
    rows_of = named.groupBy("node", "n_id", "n_hash").agg(F.count("*").alias("n"))
    least = rows_of.groupBy("node").agg(F.min(F.struct(F.col("n_id").isNull().alias("nameless"), "n_id", "n_hash", "n")).alias("one")).select("one.n_id", "one.n_hash", "one.n")
    bare = bare.groupBy("n_id", "n_hash").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("n_id").isNull(), 1).otherwise(F.col("n")))
    stays = scratch.keep(least.unionByName(bare))

    def these(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, [docs["doc_id"].eqNullSafe(chosen["n_id"]), F.xxhash64(docs["text"]) == chosen["n_hash"]], "left_semi")

    every = F.struct(*[docs[c] for c in docs.columns])
    repeated = these(stays.where("n > 1")).groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(every, F.to_json(every)).alias("one")).select("one.*")
    return these(stays.where("n = 1")).unionByName(repeated)


def op2_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"), Scratch(spark, "op2"))


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(s) AS sh FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common * 100 >= (x.n_shingles + y.n_shingles - common) * 85),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.doc_id = n.doc_id"""

QUERIES = {"op2_minhash_join": op2_minhash_join}
ORACLES = {"op2_minhash_join": _SQL}
