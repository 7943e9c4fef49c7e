"""Near-duplicate documents: BagMinHash signatures, bands, and exact verification of multiset overlap.

1. Every text gets a digest of its words and one key per band of its signature.  Texts of equal words are one node.
2. Nodes that share a band key are candidates.  Every member of a key's group is verified against the group's
   smallest node, each such pair once, and verified links are joined into components.
3. In groups that still span several components, the members outside the commonest component are probes.  Probes
   are held in blocks of bounded bytes, and all members of the group stream past each block once: an inverted
   index of the probes counts the overlaps, a few members at a time, and only links that connect something new
   come out.  A probe that has found its way into a component is not compared with that component again.  So no
   link between different components is lost, and no list of all pairs of a group is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import col, cut, fresh, on_workers
from statloom.llm.graphs import components
from statloom.llm.sketch import Shingles, band_keys, numbered, signatures
from statloom.llm.words import by_bytes

#: 42 bands of 6 slots find a pair of similarity 0.8 with probability 0.999997, of 0.9 with more than 1 - 1e-13.
BANDS, BAND_SLOTS = 42, 6
#: Candidate lists of at most so many rows (24 bytes each) are broadcast.
BROADCAST_ROWS = 500_000
#: Shingles of the probes of one block, in bytes, and matches that are counted at a time.
PROBE_BYTES = 1 << 20
MATCHES = 1_000_000
TEXT_BYTES = 2 << 20


def _sketched(bands: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, TEXT_BYTES):
                s = Shingles(part.column(2))
                keys = band_keys(signatures(s, bands * slots), bands)
                digests = np.frombuffer(b"".join(s.digests), dtype="<i8").reshape(-1, 2)
                has = s.size > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)), pa.array(keys[has].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], ["id", "th", "d1", "d2", "bands"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, 1, TEXT_BYTES):
            s = Shingles(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([numbered(s, i).tobytes() for i in range(part.num_rows)], pa.binary())], ["node", "shingles"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(i) for i in range(4))):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (s, t))
                if min(len(s), len(t)) >= threshold * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if both >= threshold * (len(s) + len(t) - both):
                        a.append(x.as_py()), b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Probes:
    """Members of a group that are looked for among the others, as an inverted index of their shingles."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.nodes: list[int] = []
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.parent: dict[int, int] = {}
        self.values = None

    def add(self, node: int, root: int, shingles: np.ndarray) -> None:
        self.nodes.append(node), self.roots.append(root), self.sets.append(shingles)

    def find(self, root: int) -> int:
        parent = self.parent
        while parent.setdefault(root, root) != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        return root

    def _index(self) -> None:
        self.size = np.array([len(x) for x in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.holder = np.repeat(np.arange(len(self.sets)), self.size)[order]
        self.values, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))

    def pass_by(self, nodes: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links between the members that come by and the probes, as few as connect what is not connected yet."""
        if self.values is None:
            self._index()
        own = {self.find(r) for r in self.roots}
        open_ = [k for k, r in enumerate(roots) if len(own) > 1 or self.find(r) not in own]
        out, at = [], 0
        while at < len(open_):
            place, hits, to, matches = [], [], at, 0
            while to < len(open_) and (to == at or matches < MATCHES):
                x = sets[open_[to]]
                p = np.minimum(np.searchsorted(self.values, x), max(len(self.values) - 1, 0))
                p = p[self.values[p] == x] if len(self.values) else p[:0]
                place.append(p), hits.append(int(self.count[p].sum()))
                matches += hits[-1]
                to += 1
            flat = np.concatenate(place)
            n = self.count[flat]
            holder = self.holder[np.repeat(self.first[flat] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            probes = len(self.sets)
            both = np.bincount(np.repeat(np.arange(to - at), hits) * probes + holder, minlength=(to - at) * probes).reshape(-1, probes)
            size = np.array([len(sets[k]) for k in open_[at:to]])
            near = (both > 0) & (both >= self.threshold * (size[:, None] + self.size - both))
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                k = open_[at + i]
                p, q = self.find(roots[k]), self.find(self.roots[j])
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    out.append((nodes[k], self.nodes[j]))
            at = to
        return out


def _settled(threshold: float):
    """Rows come by bucket and block, probes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, probes = None, None
        for batch in batches:
            links, waiting, held = [], ([], [], []), 0

            def passed():
                if waiting[0]:
                    links.extend(probes.pass_by(*waiting))  # noqa: B023
                    for x in waiting:  # noqa: B023
                        x.clear()

            bucket, block, streams, node, root = (batch.column(k).to_pylist() for k in range(5))
            for k in range(batch.num_rows):
                if (bucket[k], block[k]) != cell:
                    passed()
                    held = 0
                    cell, probes = (bucket[k], block[k]), Probes(threshold)
                shingles = np.frombuffer(batch.column(5)[k].as_buffer(), dtype=np.uint64)
                if not streams[k]:
                    probes.add(node[k], root[k], shingles.copy())
                elif probes.nodes:
                    for x, v in zip(waiting, (node[k], root[k], shingles)):
                        x.append(v)
                    held += shingles.nbytes
                    if held > PROBE_BYTES:
                        passed()
                        held = 0
            passed()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicate_classes(
    df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_slots: int = BAND_SLOTS,
) -> DataFrame:
    """(id, th, class_id, class_th): the class of each distinct (id, hash of text), named by its smallest member.

    Two documents are linked if the weighted Jaccard similarity of their five-word shingles is `threshold` or
    more; a class is a connected component.  Defined cases: null and empty texts, and texts of white space only,
    are copies of each other; texts under five words are linked only if their words are equal; words are compared
    in lower case; a very long text is read whole, by itself; a null id is smaller than all others; an empty table gives an empty result.
    """
    on_workers(df.sparkSession)
    rows = df.select(
        F.coalesce(col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("th"),
        col(text_col).alias("text"))
    sketch = cut(rows.mapInArrow(_sketched(bands, band_slots), "id long, th long, d1 long, d2 long, bands array<long>"), "dup-sketches")
    nodes = sketch.groupBy("d1", "d2").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("bucket"))
    groups = keyed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1")
    members = cut(keyed.join(groups, "bucket"), "dup-members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep.id", "rep.th"), "node")
    wanted = cut(wanted, "dup-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("node", "text")
    shingles = cut(texts.mapInArrow(_shingled, "node long, shingles binary"), "dup-shingles")

    pairs = members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    loaded = pairs.join(shingles.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b").join(
        shingles.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").select("a", "b", "sa", "sb")
    links = cut(loaded.mapInArrow(_verified(threshold), "a long, b long"), "dup-links")
    found = cut(components(links, "dup-roots"), "dup-found")

    rooted = members.where("members > 2").select("bucket", "node", "members").join(found, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    rooted = cut(rooted, "dup-rooted")
    sizes = shingles.select(F.col("node"), F.octet_length("shingles").alias("bytes"))
    shares = rooted.join(sizes, "node").groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per_bucket = shares.groupBy("bucket").agg(
        F.count("*").alias("roots"), F.max(F.struct("n", "root", "bytes")).alias("most"), F.sum("bytes").alias("bytes")).where("roots > 1")
    # the probes are all but the members of the commonest component
    per_bucket = cut(per_bucket.select("bucket", F.col("most.root").alias("commonest"), F.ceil(
        (F.col("bytes") - F.col("most.bytes")) / F.lit(PROBE_BYTES)).cast("int").alias("blocks")), "dup-open")
    opened = rooted.select("bucket", "node", "root").join(per_bucket, "bucket").withColumn("blocks", F.greatest("blocks", F.lit(1)))
    cells = opened.where("root != commonest").select(
        "bucket", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(False).alias("streams"), "node", "root").union(opened.select(
            "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("streams"), "node", "root"))
    cells = cells.join(shingles, "node").select("bucket", "block", "streams", "node", "root", "shingles")
    cells = cells.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "streams")
    more = cut(cells.mapInArrow(_settled(threshold), "a long, b long"), "dup-more-links")
    if more.take(1):
        stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = cut(components(stars.union(more), "dup-roots"), "dup-found")

    linked = found.join(nodes.select("node", "rep"), "node")
    names = linked.groupBy("root").agg(F.min("rep").alias("name"))
    named = nodes.select("d1", "d2", "node", "rep").join(found.join(names, "root").select("node", "name"), "node", "left").select(
        "d1", "d2", F.coalesce("name", "rep").alias("name"))
    return sketch.select("id", "th", "d1", "d2").distinct().join(named, ["d1", "d2"]).select(
        "id", "th", F.col("name.id").alias("class_id"), F.col("name.th").alias("class_th"))


def mark_near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                         class_out: str = "class_id", first_out: str = "is_first") -> DataFrame:
    """All rows and columns, with the smallest id of their class and whether the row is the class's first text.

    Rows that repeat both id and text are all marked alike.  Cases as in near_duplicate_classes; the class of
    documents without an id has a null name.
    """
    base = df.drop(class_out, first_out)
    i, t = fresh(base, "dup_id"), fresh(base, "dup_hash")
    classes = near_duplicate_classes(base, threshold, id_col, text_col).withColumnsRenamed({"id": i, "th": t})
    low = F.lit(-(2**63))
    keyed = base.withColumns({
        i: F.coalesce(col(id_col).cast("long"), low), t: F.xxhash64(F.coalesce(col(text_col), F.lit("")))})
    c, h = fresh(keyed, "dup_class"), fresh(keyed, "dup_class_hash")
    out = keyed.join(classes.withColumnsRenamed({"class_id": c, "class_th": h}), [i, t])
    first = (F.col(i) == F.col(c)) & (F.col(t) == F.col(h))
    return out.select(*[col(x) for x in base.columns], F.when(F.col(c) != low, F.col(c)).alias(class_out), first.alias(first_out))


def keep_first_of_class(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate class: its smallest id; rows that repeat id and text count once."""
    base = df
    f, c = fresh(base, "dup_first"), fresh(base, "dup_name")
    t = fresh(base, "dup_text_hash")
    marked = mark_near_duplicates(base, threshold, id_col, text_col, c, f).where(F.col(f)).withColumn(t, F.xxhash64(F.coalesce(col(text_col), F.lit(""))))
    return marked.dropDuplicates([id_col, t]).select(*[col(x) for x in df.columns])
