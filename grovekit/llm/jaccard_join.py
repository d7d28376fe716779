"""Self-join of documents by the Jaccard similarity of their word shingles (vertical partitioning).

The shingle hashes give the global order; the order is cut into fragments, and a document is the row of
its fragments. Let x and y link, x the smaller, with |x| <= s. Then they differ in at most
D = s * (1 - t) / t shingles, so of D + 1 + E fragments at least E + 1 are the same in both. Sizes are put
into classes so narrow that a partner's class is the same or the next; each class has its own number
of fragments, and a document writes one key per filled fragment for its own class and for the class below.
Documents with more than E empty fragments in a scheme, where "the same" may mean "empty in both" each time, also write the keys
of the prefix filter there. So every link meets in a key, however common a shingle is in unrelated texts.

The overlap of a pair is counted fragment by fragment and summed. Fragments in which both are the same are known from
the join already, and their sizes alone carry some links over the threshold. Parity sketches, an exact lower bound of the
differences at a thirtieth of a set's bytes, rule out most pairs that don't link. For the rest the partial overlaps are counted
separately in ``COUNT_FRAGMENTS`` fixed fragments.
Equal sets are one node from the start. Inside a key the node with the most company is the centre: first
all others are compared with it only, and components are formed; of what is left only pairs of different
components matter, because a pair inside one component adds nothing.

In a key of ``small_key`` nodes or fewer beside the centre, such pairs are just listed. The nodes of larger ones meet
by a prefix filter over their sets, each node once, however many such keys it is in: under one order of all shingles a set x
shares a shingle of its first |x| - t |x| + 1 with whatever it links with. The order puts shingles of rare buckets first, so
that what a group has in common comes last and makes no meetings. One of a pair must be far from a centre (not in its
component), and a meeting is held against the threshold by sizes and by the positions of the shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import WordHashes, checkpointed, mixed, released, salted, shingle_hashes, small_batches, whole_row, words_of
from grovekit.llm.components import components

COUNT_FRAGMENTS = 4
#: Parts into which the rows of a hot key are dealt, and the rows from which a join key counts as hot.
SALTS, HOT = 8, 1000
#: Members of the centre's component that a node which doesn't link with the centre is compared with next.
SCOUTS = 8
ROOM = 1 << 15
#: Buckets in which the shingles of nodes with large keys are counted.
BUCKETS = 1 << 18


def size_classes(percent: int, largest: int) -> list[int]:
    """First size of each class; a set and a larger partner are in one class or in neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


def fragment_keys(shingles: np.ndarray, percent: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of one sorted set of hashes, and for each of them a tag.

    A tag is its scheme's parity (2: prefix key) + 4 * size of the fragment (cut at ROOM // 4 - 1) + ROOM * hits that may be missing: what a linked set
    shares in this scheme are more filled fragments than this number, less one.
    """
    n = len(shingles)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)))
    keys, sizes, prefix = [], [], n - -(-n * percent // 100) + 1
    for scheme in (own, own - 1):
        if scheme < 0:
            continue
        differences = int(starts[scheme + 1] - 1) * (100 - percent) // percent
        spare = differences // 10 + (2 if differences >= 7 else 1)
        count = differences + 1 + spare
        which = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        edges = np.searchsorted(which, np.arange(count + 1, dtype=np.uint64))
        filled = edges[1:] > edges[:-1]
        missing = count - int(filled.sum())
        tag = np.arange(count, dtype=np.uint64) + np.uint64((scheme + 1) << 40)
        keys.append(mixed((sums[edges[1:]] - sums[edges[:-1]]) ^ mixed(tag))[filled])
        sizes.append((4 * np.minimum(np.diff(edges), ROOM // 4 - 1) + scheme % 2 + ROOM * min(max(0, spare - missing + 1), ROOM))[filled])
        if missing > spare:
            keys.append(mixed(shingles[:prefix] ^ mixed(tag[-1:] + np.uint64(1))))
            sizes.append(np.full(prefix, 6))
    return np.concatenate(keys).view(np.int64), np.concatenate(sizes).astype(np.int32)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        for at in range(0, batch.num_rows, 512):
            part = texts.slice(at, 512).to_pylist()
            yield batch.slice(at, 512), [np.unique(shingle_hashes(hashes.of(words_of(t)), k)) for t in part]


def _signature(s: np.ndarray) -> tuple[int, int] | None:
    """128 bits that stand for the set, as two signed 64-bit numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()) if len(s) else None


class Renamed(dict):
    """(first half, second half) of a signature to its node: the first half, but for the few that share it with another signature."""

    def __missing__(self, signature: tuple[int, int]) -> int:
        return signature[0]

    def of(self, s: np.ndarray) -> int | None:
        signature = _signature(s)
        return None if signature is None else self[signature]


def _signatures(k: int, carried: tuple[str, ...]):
    def run(batches):
        for batch, sets in _sets(batches, k):
            both = [_signature(s) or (None, None) for s in sets]
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *own], names=[*carried, "n_shingles", "node", "check"])

    return run


def _keys(k: int, percent: int, renamed: Renamed):
    def run(batches):
        starts, seen = np.array(size_classes(percent, 1 << 40)), set()
        for _, sets in _sets(batches, k):
            nodes, keys, sizes = [], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for s in sets:
                node = renamed.of(s)
                if node is not None and node not in seen:
                    if len(seen) >= 50_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    own, size = fragment_keys(s, percent, starts)
                    keys.append(own)
                    sizes.append(size)
            lengths = [len(x) for x in keys[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], names=["node", "key", "size"])

    return run


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """For each remainder of the hashes by a power of two (twice the size or more), whether an odd number of them has it; 64 to a word.

    Two sets differ in at least as many shingles as their sketches differ in bits. A sketch of half the width is the
    exclusive or of its halves.
    """
    width = max(256, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _fragments(k: int, renamed: Renamed):
    def run(batches):
        for _, sets in _sets(batches, k):
            nodes, sizes, which, parts, sketches = [], [], [], [], []
            for s in sets:
                if len(s):
                    edges = np.searchsorted(s >> np.uint64(62), np.arange(COUNT_FRAGMENTS + 1, dtype=np.uint64))
                    for f in range(COUNT_FRAGMENTS):
                        nodes.append(renamed.of(s))
                        sizes.append(len(s))
                        which.append(f)
                        parts.append(s[edges[f] : edges[f + 1]].view(np.int64))
                        sketches.append(None if f else parity_sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(which, pa.int32()), pa.array(parts, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["node", "n", "fragment", "shingles", "sketch"])

    return run


def _of_nodes(fragments: DataFrame, pairs: DataFrame, broadcast_rows: int, *ends: str) -> DataFrame:
    """The fragments of the nodes at the ``ends`` of ``pairs`` (a written table). Up to ``broadcast_rows`` nodes are sent to the fragments,
    so that only these are dealt out; more are left to the joins that follow."""
    nodes = pairs.select(F.explode(F.array(*ends)).alias("node")).distinct()
    return fragments.join(F.broadcast(nodes), "node", "left_semi") if len(ends) * pairs.count() <= broadcast_rows else fragments


def _links(pairs: DataFrame, fragments: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps per fragment, summed per pair."""
    pairs = checkpointed(pairs, free=True)
    fragments = _of_nodes(fragments, pairs, broadcast_rows, "a", "b")
    left = fragments.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("shingles").alias("in_a"))
    right = fragments.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("shingles").alias("in_b"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("in_a", "in_b")).cast("long").alias("common"))
    once = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("common").alias("common"))
    return once.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common")).where(_similar(percent)).select("a", "b")


def _bounded(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't show already that they differ in too many shingles."""
    sketches = fragments.where("fragment = 0")
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    folded = "transform(sequence(1, {0}), i -> aggregate(sequence(i, size({1}), {0}), 0L, (x, j) -> x ^ element_at({1}, j)))"
    width = "least(size(s_a), size(s_b))"
    one, other = (f"CASE WHEN size({s}) = {width} THEN {s} ELSE {folded.format(width, s)} END" for s in ("s_a", "s_b"))
    bits = f"aggregate(zip_with({one}, {other}, (x, y) -> bit_count(x ^ y)), 0L, (x, y) -> x + y)"
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(F.expr(f"{100 + percent} * {bits} <= {100 - percent} * (n_a + n_b)")).select("a", "b")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's shingles fall in each of ``BUCKETS`` buckets."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        counts += np.bincount(np.asarray(batch.column("shingles").flatten(), np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["bucket", "n"])


def rarest(shingles: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set: so many of its shingles, those of rare buckets first, that it shares one of them with whatever it links with."""
    own = np.unique(shingles)
    return own[np.lexsort((own, often[own & (BUCKETS - 1)]))][: len(own) - -(-len(own) * percent // 100) + 1]


def _rarest(often: np.ndarray, percent: int):
    def run(batches):
        for batch in batches:
            prefixes = [rarest(np.asarray(s.values, np.int64), often, percent) for s in batch.column("shingles")]
            lengths = [len(x) for x in prefixes]
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            place = np.concatenate([np.empty(0, np.int64), *map(np.arange, lengths)]) + 1
            kept = ["node", "component", "far", "n"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], pa.array(place), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes]))], names=[*kept, "place", "shingle"])

    return run


def _prefixes(nodes: DataFrame, fragments: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """Each of ``nodes(node, component, far)`` once, with a row per shingle of its prefix; ``place`` is the shingle's position from 1.

    The order is one for all nodes: by how many of the nodes' shingles are in a bucket, from counts of a fixed size. Any order loses no link.
    """
    nodes = checkpointed(nodes, free=True)
    fragments = _of_nodes(fragments, nodes, broadcast_rows, "node").join(nodes, "node")
    counts = fragments.select("shingles").mapInArrow(released(_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    whole = fragments.groupBy("node", "component", "far", "n").agg(F.flatten(F.collect_list("shingles")).alias("shingles"))
    return whole.mapInArrow(released(_rarest(often, percent)), "node long, component long, far boolean, n long, place long, shingle long")


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, one of them far from a centre, that may link by the first shingle that their prefixes share."""
    x = prefixes.where("far").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "component", "n", "place")])
    y = prefixes.select(F.col("shingle").alias("shingle_y"), *[F.col(c).alias(f"{c}_y") for c in ("node", "component", "n", "place")])
    fits = F.expr(
        f"component_x <> component_y AND 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) AND "
        f"{100 + percent} * (1 + least(n_x - place_x, n_y - place_y)) >= {percent} * (n_x + n_y)"
    )
    met = x.join(y, (F.col("shingle") == F.col("shingle_y")) & fits)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _similar(percent: int):
    return F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ...) with n_a and n_b; pairs whose sizes alone are too different leave."""
    both = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    return both.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))


def _members(docs: DataFrame, k: int, *carried) -> tuple[DataFrame, DataFrame, Renamed]:
    """A row per row of ``docs`` with n_shingles and node (and ``carried`` columns); a row per node; and the nodes' names.

    Nodes are the first halves of signatures of 128 bits. Of n sets about n * n / 2 ** 65 share such a half with another set
    (some three hundred of 10 ** 11): these few are found, sent to all tasks, and get names of their own.
    """
    small_batches(docs.sparkSession)
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    names = tuple(c for c in documents.columns if c != "text")
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in names)
    members = checkpointed(documents.mapInArrow(released(_signatures(k, names)), f"{kinds}, n_shingles long, node long, check long"))
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names[1:])).alias("first")]
    nodes = checkpointed(members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("n_shingles").alias("n"), *first))
    alike = members.join(F.broadcast(nodes.where("lo <> hi").select("node")), "node").select("node", "check").distinct().orderBy("node", "check").collect()
    if not alike:
        return members, nodes, Renamed()
    taken, renamed = {r["node"] for r in alike}, Renamed()
    for i, r in enumerate(alike):
        name = r["node"]
        if i and alike[i - 1]["node"] == name:
            while name in taken:
                name = int(mixed(np.array([name ^ r["check"]]).view(np.uint64)).view(np.int64)[0])
            taken.add(name)
        renamed[r["node"], r["check"]] = name
    table = members.sparkSession.createDataFrame([(a, b, n) for (a, b), n in renamed.items()], "node long, check long, name long")
    members = checkpointed(members.join(F.broadcast(table), ["node", "check"], "left").withColumn("node", F.coalesce("name", "node")).select(*names, "n_shingles", "node", "check"))
    nodes = checkpointed(members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"), *first))
    return members, nodes, renamed


def _linked(docs: DataFrame, nodes: DataFrame, renamed: Renamed, k: int, percent: int, broadcast_rows: int, small_key: int) -> DataFrame:
    """(node, component) of each node that links with another."""
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = documents.mapInArrow(released(_keys(k, percent, renamed)), "node long, key long, size int").repartition("key")
    shared = keys.groupBy("key").agg(F.count("*").alias("company"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("size").alias("largest")).where("lo <> hi AND largest > 0").select("key", "company")
    met = checkpointed(keys.join(shared.hint("shuffle_hash"), "key").groupBy("key", "node").agg(F.max("company").alias("company"), F.max("size").alias("size")), free=True)
    support = met.groupBy("node").agg(F.sum("company").alias("support"))
    homes = checkpointed(support.join(nodes.select("node", F.col("first.doc_id").alias("home"), "n"), "node"))

    wanted = homes.select(F.coalesce("home", F.lit(-(1 << 63))).alias("home")).distinct()
    if homes.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    texts = documents.join(wanted, F.coalesce(documents["doc_id"], F.lit(-(1 << 63))) == wanted["home"], "left_semi")
    fragments = checkpointed(texts.mapInArrow(released(_fragments(k, renamed)), "node long, n long, fragment int, shingles array<long>, sketch array<long>"), free=True)

    # A key may hold a large share of the nodes, so its rows are dealt out by salt, and what is one row a key goes to each salt.
    centres = met.join(homes, "node").groupBy("key").agg(F.max(F.struct("support", "node")).alias("c"), F.max("company").alias("n")).select("key", "n", F.col("c.node").alias("centre"))
    around = salted(met, SALTS, F.col("node"), F.col("company") > HOT).join(salted(centres, SALTS, hot=F.col("n") > HOT).drop("n"), ["key", "salt"]).where("node <> centre")
    around = checkpointed(around.select("key", "salt", "company", "size", "node", "centre"), free=True)
    parity = lambda p: F.sum(F.when(F.col("size") % 4 == p, F.expr(f"size % {ROOM} DIV 4")).otherwise(0))
    meetings = around.groupBy(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(F.greatest(parity(0), parity(1)).alias("common"))
    tried = checkpointed(_sized(meetings, homes, percent), free=True)
    sure = tried.where(_similar(percent)).select("a", "b")
    links = checkpointed(sure.unionByName(_links(_bounded(tried.where(~_similar(percent)), fragments, percent), fragments, percent, broadcast_rows)), free=True)
    label = checkpointed(components(links))

    # Those that the centre leaves open first meet a few others of its component: of a group of near copies that is all but a few.
    placed = _placed(around, label)
    near = placed.where("component = component_c").groupBy("key", F.pmod(F.hash("node"), F.lit(SCOUTS)).alias("turn")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("x"), F.max("company").alias("n"))
    scouts = salted(near.select("key", "n", F.col("x.node").alias("scout")), SALTS, hot=F.col("n") > HOT).drop("n")
    far = placed.where("component <> component_c").groupBy("node", "centre").agg(F.min(F.struct("key", "company")).alias("x")).select("node", "x.*")
    asked = salted(far, SALTS, F.col("node"), F.col("company") > HOT).join(scouts, ["key", "salt"]).select(F.least("node", "scout").alias("a"), F.greatest("node", "scout").alias("b")).distinct()
    asked = checkpointed(_sized(asked.join(tried, ["a", "b"], "left_anti"), homes, percent).select("a", "b"), free=True)
    links = checkpointed(links.unionByName(_links(_bounded(asked, fragments, percent), fragments, percent, broadcast_rows)), free=True)
    tried = tried.select("a", "b").unionByName(asked)

    around = checkpointed(_placed(around, checkpointed(components(links))), free=True)
    open_keys = around.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("others"), F.max("company").alias("n")).where("lo <> hi").select("key", "others", "n")
    beside = checkpointed(around.join(salted(open_keys, SALTS, hot=F.col("n") > HOT).drop("n"), ["key", "salt"]), free=True)
    few, many = beside.where(F.col("others") <= small_key), beside.where(F.col("others") > small_key)
    # What many unlike texts share gives them large keys. A node with fewer of these in a scheme than the hits that may be missing there
    # meets whatever it links with in another key as well, so it leaves them.
    bare = many.groupBy("node", F.expr("size % 4").alias("scheme")).agg(F.count("*").alias("large"), F.max(F.expr(f"size DIV {ROOM}")).alias("spare")).where("scheme = 2 OR large >= spare").select("node", "scheme")
    many = many.withColumn("scheme", F.expr("size % 4")).join(bare, ["node", "scheme"]).drop("scheme", "others")
    left = many.groupBy("key").agg(F.count("*").alias("others"), F.max("company").alias("n")).where("others > 1")
    many = checkpointed(many.join(salted(left, SALTS, hot=F.col("n") > HOT).drop("n"), ["key", "salt"]), free=True)
    few, many = few.drop("company").unionByName(many.where(F.col("others") <= small_key).drop("company")), many.where(F.col("others") > small_key)
    partner = few.select("key", F.col("node").alias("b"), F.col("component").alias("component_b"))
    direct = few.withColumnRenamed("node", "a").join(partner, "key").where("a < b AND component <> component_b").select("a", "b")
    many = many.groupBy("node", "component").agg(F.max(F.col("component") != F.col("component_c")).alias("far"))
    met_again = direct.unionByName(_meetings(_prefixes(many, fragments, percent, broadcast_rows), percent)).distinct()
    rest = _bounded(met_again.join(tried, ["a", "b"], "left_anti"), fragments, percent)
    return components(links.unionByName(_links(rest, fragments, percent, broadcast_rows))).select("node", "component")


def _placed(around: DataFrame, label: DataFrame) -> DataFrame:
    """``around`` with the components of node and centre; a node without links is one of its own."""
    of_centre = label.select(F.col("node").alias("centre"), F.col("component").alias("component_c"))
    both = around.select("key", "salt", "company", "size", "node", "centre").join(label, "node", "left").join(of_centre, "centre", "left")
    return both.select("key", "salt", "company", "size", "node", "centre", F.coalesce("component", "node").alias("component"), F.coalesce("component_c", "centre").alias("component_c"))


def _firsts(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(node, rows, first) of each node that is not alone: rows and first row of all that is linked with it."""
    joined = nodes.select("node", "rows", "first").join(label, "node", "left").where("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    joined = checkpointed(joined)
    whole = joined.groupBy("component").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"))
    return checkpointed(salted(joined.select("node", "component"), SALTS, F.col("node")).join(salted(whole, SALTS), ["component", "salt"]).select("node", "rows", "first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, broadcast_rows: int = 500_000, small_key: int = 16) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their distinct k-word shingles is at least
    ``percent`` / 100 (a similarity of just that is a link); component_id is the smallest doc_id reachable by links. A text with fewer
    than k words is one shingle, a very long one is taken whole; a null, empty or blank text has none and is its own component. A null
    doc_id takes part with its text and is never the smallest id unless its whole component has no id. Repeated rows and
    repeated ids are rows of their own. Other columns are not read.
    """
    members, nodes, renamed = _members(docs, k)
    firsts = _firsts(nodes, _linked(docs, nodes, renamed, k, percent, broadcast_rows, small_key))
    # ``members`` is a written table, so its row numbers stay; a node that very many rows have is dealt out by them.
    dealt = members.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    whole = dealt.join(salted(firsts, SALTS), ["node", "salt"], "left")
    return whole.select("doc_id", "n_shingles", F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80, broadcast_rows: int = 500_000, small_key: int = 16) -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all their columns: of rows that are linked, directly or through others, one stays.

    It is the one with the smallest doc_id (a null id counts as the largest); of several with that id the one with the smallest hash of all
    columns. Of rows equal in all columns one stays. Rows decide, not ids: two unlike texts of one id both stay. Texts without words stay.
    Columns of map type have no hash in Spark and are refused by it.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")
    members, nodes, renamed = _members(docs, k, *keys)
    firsts = _firsts(nodes, _linked(docs, nodes, renamed, k, percent, broadcast_rows, small_key))
    same = F.expr("k1 = first.k1 AND k2 = first.k2 AND doc_id <=> first.doc_id")
    marks = checkpointed(members.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted(firsts, SALTS), ["node", "salt"]).groupBy("k1", "k2").agg(F.max(same).alias("stays"), F.count("*").alias("copies")))
    keyed = docs.select(whole_row(docs).alias("row"), *keys).join(marks, ["k1", "k2"], "left")
    once = keyed.where("copies IS NULL OR (stays AND copies = 1)").select("row")
    repeated = keyed.where("stays AND copies > 1").dropDuplicates(["k1", "k2"]).select("row")
    return once.unionByName(repeated).select("row.*")
