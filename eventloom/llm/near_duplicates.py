"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its five-word shingles (or, with fewer words, all of them
as one) with their counts. Each unit of weight of an element is a strip on which hashed
darts land as a Poisson process in rank; a document keeps the darts below a rank that
lets about k ln k + 2 k of them in, whatever its length, and of those the earliest in
each of k coordinates. Two documents agree on a coordinate with probability equal to
their weighted Jaccard similarity. If a coordinate stays empty the rank is doubled.

Joining. Equal word sequences are one text from the start. The signatures of the texts
are cut into bands; texts with an equal band form a group. In each group the member that
shares most bands with others overall (the original among its copies) is the hub; the
others are compared with it, exactly, on their texts. Where some differ from their hub,
the group's members are grouped anew by narrower bands of longer signatures, again with a
hub each. Where the links so far leave a finer band's members in more than one piece, all
members of unequal pieces, alike to the hub or not, are compared in blocks of bounded size:
by their signatures, and where these come near, on their texts. Every link is verified on
texts. Rows stay linear in the members: no group is gathered or emitted as pairs. Links give
classes by spreading the least label along links and labels.

Every exchange is by hash with partial sums before it or is a plain equi-join, which
Spark splits where a key is hot. Tables between rounds are written to the shared folder.

Edge cases: a null text or one without words is alone in its class; a row without doc_id
takes no part (class_id null); repeated rows share a class, and one of them is kept; ties go
to the smaller id; rows of one id and different texts may be of different classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Rolling, binary, ensure_importable, few_files, forget, hash_words, mix, mix2, written

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Of pairs alike by 0.8 these miss 2.3e-5, the first level 2.6e-5.
FINE_BANDS, FINE_ROWS = 74, 9
#: Rows, and bytes of text, in each of the two chunks of a band that one task compares; what a
#: sketch of 666 bytes may fall short of the similarity it stands for (four deviations).
PART, PART_BYTES, SLACK = 1024, 8 << 20, 0.065


def shingles(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, sorted by document and hash.

    Hashes are of 56 bits, so they are the same in every slice of up to 256 texts."""
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words))
    first = place == (ends - counts)[doc] if len(words) else np.zeros(0, bool)
    start = place[(place + size <= ends[doc]) | (first & (counts[doc] < size))] if len(words) else place
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = doc[start]
    hashes = Rolling(words).spans(start, np.minimum(start + size, ends[owner])) + mix(np.minimum(counts[owner], size).astype(np.uint64), 5)
    # one sort of 64-bit keys: the document above, as many bits of the hash as are left below
    bits = np.uint64(64 - max(8, (len(texts) - 1).bit_length()))
    keys = np.sort((owner.astype(np.uint64) << bits) | (hashes >> (np.uint64(64) - bits)))
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    found = keys[at]
    return (found >> bits).astype(np.int64), found << (np.uint64(64) - bits), np.diff(np.append(at, len(keys)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """docs x k names of earliest darts; rows of documents without elements stay 0.

    Weights may be any positive numbers: a dart on the last, partial strip of an element
    counts if it lands within the part that is there."""
    out = np.zeros((docs, k), np.uint64)
    if not len(doc):
        return out
    whole = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), whole)
    strip = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    room, owner = weight[of] - strip, doc[of]
    unit = mix2(element[of], strip.astype(np.uint64), 21)
    total = np.bincount(doc, weights=weight, minlength=docs)
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    left = np.unique(doc)
    every = len(left) == docs
    while len(left):
        if every:
            u, o, f = unit, owner, room
        else:
            open_ = np.zeros(docs, bool)
            open_[left] = True
            take = open_[owner]
            u, o, f = unit[take], owner[take], room[take]
        every = False
        rank = np.zeros(len(u))
        found: list[tuple[np.ndarray, ...]] = []
        n = 0
        while len(u):
            dart = mix(u, 31 + n)
            # the gap to the next dart is -log(1 - x); most are beyond the limit, which x shows by itself
            x = (dart >> np.uint64(11)).astype(float) * 2.0**-53
            near = x < -np.expm1(rank - limit[o])
            u, o, f, dart = u[near], o[near], f[near], dart[near]
            rank = rank[near] - np.log1p(-x[near])
            lands = ((mix(dart, 41) >> np.uint64(11)).astype(float) * 2.0**-53) < f
            found.append((o[lands], rank[lands], mix(dart[lands], 51)))
            n += 1
        o, r, name = (np.concatenate(x) for x in zip(*found, strict=True))
        cell = o * k + (name % np.uint64(k)).astype(np.int64)
        # ranks are positive, so their bits are in order too
        bits = np.uint64(64 - max(1, (docs * k - 1).bit_length()))
        order = np.argsort((cell.astype(np.uint64) << bits) | (r.view(np.uint64) >> (np.uint64(64) - bits)))
        cell, name = cell[order], name[order]
        first = np.append(True, cell[1:] != cell[:-1])
        out.reshape(-1)[cell[first]] = name[first]
        full = np.bincount(cell[first] // k, minlength=docs)
        left = left[full[left] < k]
        limit[left] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """docs x bands: one 64-bit key for the `rows` names of each band."""
    cells = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), cells.shape[:2])
    for r in range(rows):
        key = mix2(key.astype(np.uint64), cells[:, :, r], 61)
    return key


def node_of(text: bytes) -> bytes:
    """The name of a word sequence: 128 bits of its words."""
    return xxhash.xxh3_128_digest(b" ".join(text.split()))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, mark (of the raw text), node and bands of each row; node null without words."""

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = b.column(2).cast(pa.binary()).to_pylist()
                d, h, w = shingles(texts, size)
                keys = band_keys(dart_signatures(d, h, w.astype(float), len(texts), bands * rows), bands, rows).view(np.int64)
                some = np.zeros(len(texts), bool)
                some[d] = True
                nodes = [node_of(t) if s else None for t, s in zip(texts, some.tolist(), strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary(nodes), flat], names=["doc_id", "mark", "node", "bands"])

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, mark long, node binary, bands array<long>")


def _overlap(h: np.ndarray, w: np.ndarray, g: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of hashes with counts."""
    total = int(w.sum()) + int(v.sum())
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    both = int(np.minimum(w[i], v[j]).sum())
    return both / (total - both) if total > both else float(total > 0)


def similarity(a: bytes, b: bytes, size: int = SHINGLE) -> float:
    """Exact weighted Jaccard similarity of the shingle counts of two texts."""
    d, h, w = shingles([a, b], size)
    cut = np.searchsorted(d, 1)
    return _overlap(h[:cut], w[:cut], h[cut:], w[cut:])


def _verified(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (node, hub) with their exact similarity at least `least`, and the rest."""

    def run(batches):
        for b in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            a, c = b.column("text").cast(pa.binary()).to_pylist(), b.column("hub_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("hub"), pa.array([similarity(x, y, size) >= least for x, y in zip(a, c, strict=True)], pa.bool_())], names=["node", "hub", "alike"])

    hubs = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
    return pairs.join(texts, "node").join(hubs, "hub").select("node", "hub", "text", "hub_text").mapInArrow(run, "node binary, hub binary, alike boolean")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (band, node) of bands that more than one node has, with the band's size."""
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes, "band")


def _with_standing(rows: DataFrame) -> DataFrame:
    """band, node, standing: how many nodes share a node's bands, over all its bands."""
    return rows.join(rows.groupBy("node").agg(F.sum("n").alias("standing")), "node").select("band", "node", "standing")


def _at_hubs(group: DataFrame) -> DataFrame:
    """band, node, standing, hub for all but the hub of each band of more than one node."""
    hubs = group.groupBy("band").agg(F.max(F.struct("standing", "node")).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", F.col("top.node").alias("hub"))
    return group.join(hubs, "band").where("node <> hub")


def _finer(texts: DataFrame, size: int) -> DataFrame:
    """node, bands, sketch of texts (node, text): narrower bands of longer signatures, and a
    byte of each of their names."""

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                d, h, w = shingles(b.column("text").cast(pa.binary()).to_pylist(), size)
                names = dart_signatures(d, h, w.astype(float), b.num_rows, FINE_BANDS * FINE_ROWS)
                keys = band_keys(names, FINE_BANDS, FINE_ROWS).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * FINE_BANDS + 1, FINE_BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("node"), flat, binary([r.tobytes() for r in (names >> np.uint64(8)).astype(np.uint8)])], names=["node", "bands", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node binary, bands array<long>, sketch binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, node, label, ...) with i, j, the two chunks that meet, and chunk, the row's own.

    Only rows of unequal labels have to meet. The commonest label of a band makes its own
    chunks, which meet those of the others but not each other. A chunk is of PART rows or
    PART_BYTES of text, about; rows are repeated once a chunk, never once a row."""
    rows = rows.withColumn("bytes", F.length("text") if "text" in rows.columns else F.lit(0))
    parts = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    chunks = lambda n, size: F.ceil(F.greatest(n / PART, size / PART_BYTES)).cast("int")
    tops = parts.groupBy("band").agg(F.max(F.struct("n", "label", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > top.n")
    tops = tops.select("band", F.col("top.label").alias("top"), chunks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"), chunks(F.col("top.n"), F.col("top.bytes")).alias("tops"))
    dealt = rows.drop("bytes").join(tops, "band")
    hashed, own = F.xxhash64("node"), F.col("label") == F.col("top")
    chunk = F.when(own, F.col("others") + F.pmod(hashed, F.col("tops"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    last = F.when(own, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    met = dealt.withColumn("chunk", chunk).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumns({"i": F.least("chunk", "with"), "j": F.greatest("chunk", "with")}).drop("with", "top", "others", "tops")


def _candidates(key: tuple, table: pa.Table, least: float) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and labels (as numbers) of a block, and its pairs of rows of unequal labels whose
    sketches come near `least`, with their likeness. If the rows tell their bands, pairs
    count in the first band that they share."""
    nodes, chunk = table.column("node").to_pylist(), table.column("chunk").to_numpy()
    numbers: dict[bytes, int] = {}
    label = np.array([numbers.setdefault(v, len(numbers)) for v in table.column("label").to_pylist()])
    x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), -1)
    bands = np.array(table.column("bands").to_pylist()) if "bands" in table.column_names else None
    band, i, j = (v.as_py() for v in key)
    right = np.flatnonzero(chunk == j)
    first, second, likeness = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for k in np.flatnonzero(chunk == i):
        to = right[label[right] != label[k]]
        to = to[to > k] if i == j else to
        alike = (x[to] == x[k]).mean(1) if len(to) else np.zeros(0)
        near = alike >= least - SLACK
        to, alike = to[near], alike[near]
        if bands is not None and len(to):
            here = bands[k][(bands[to] == bands[k]).argmax(1)] == band
            to, alike = to[here], alike[here]
        first.append(np.full(len(to), k))
        second.append(to)
        likeness.append(alike)
    return nodes, label, np.concatenate(first), np.concatenate(second), np.concatenate(likeness)


def _in_pieces(rows: DataFrame) -> DataFrame:
    """The rows (band, node, label) of bands of more than one label."""
    mixed = rows.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("band")
    return rows.join(mixed, "band", "left_semi")


def _near(rows: DataFrame, least: float) -> DataFrame:
    """Of rows (band, node, label, sketch, bands) those with a row of another label near them
    that they meet in this band first: band, node."""

    def run(key, table):
        nodes, _, a, b, _ = _candidates(key, table, least)
        found = [nodes[k] for k in np.unique(np.append(a, b))]
        return pa.table({"band": pa.array([key[0].as_py()] * len(found), pa.int64()), "node": binary(found)})

    met = _blocks(rows).select("band", "i", "j", "chunk", "node", "label", "sketch", "bands")
    return met.groupBy("band", "i", "j").applyInArrow(run, "band long, node binary").distinct()


def _closest(rows: DataFrame, least: float, size: int = SHINGLE) -> DataFrame:
    """node, hub: links that join all rows of a band (band, node, sketch) that are alike.

    Rows may have a label: those of equal labels are joined already. With a text, likeness
    is exact wherever sketches come near `least`; else sketches decide. A block's pairs are
    tried from the closest on, all but those between rows that its links have joined by
    then. So no likeness between families is lost, and a block returns fewer links than it
    has rows."""
    rows = rows if "label" in rows.columns else rows.withColumn("label", F.col("node"))
    exact = "text" in rows.columns

    def run(key, table):
        nodes, label, a, b, likeness = _candidates(key, table, least)
        order = np.argsort(-likeness, kind="stable")
        texts = table.column("text").cast(pa.binary()) if exact else None
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        top = list(range(int(label.max()) + 1))

        def find(v):
            while top[v] != v:
                top[v] = v = top[top[v]]
            return v

        def counts(k):
            if k not in sets:
                sets[k] = shingles([texts[k].as_py()], size)[1:]
            return sets[k]

        found = set()
        for k, t in zip(a[order].tolist(), b[order].tolist(), strict=True):
            u, v = find(label[k]), find(label[t])
            if u != v and (not exact or _overlap(*counts(k), *counts(t)) >= least):
                top[u] = v
                found.add((min(nodes[k], nodes[t]), max(nodes[k], nodes[t])))
        return pa.table({"node": binary([p for p, _ in sorted(found)]), "hub": binary([q for _, q in sorted(found)])})

    met = _blocks(rows).select("band", "i", "j", "chunk", "node", "label", "sketch", *["text"] * exact)
    return met.groupBy("band", "i", "j").applyInArrow(run, "node binary, hub binary").distinct()


def _joined(edges: DataFrame, files: int) -> DataFrame:
    """node, label: for each node of edges (node, hub) a node that stands for its component."""
    ends = edges.select("node").union(edges.select("hub")).distinct()
    found = classes(edges, ends.select("node", F.col("node").alias("name")), files)
    out = written(found.select("node", F.col("label.node").alias("label")), files=files)
    forget(found)
    return out


def links(sig: DataFrame, docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Distinct links (node, hub) between different texts: enough to join all that are alike."""
    files = few_files(docs)
    texts = sig.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.first("bands").alias("bands"))
    members = texts.select("node", F.struct("at.doc_id", "at.mark").alias("at"), F.explode("bands").alias("band"))
    members = written(_crowded(members), files=files)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    named = members.groupBy("node").agg(F.min("at").alias("at")).select("node", "at.doc_id", "at.mark")
    wanted = written(source.join(named, ["doc_id", "mark"]).groupBy("node").agg(F.first("text").alias("text")), files=files)
    at_hub = written(_at_hubs(_with_standing(members.select("band", "node", "n"))), files=files)
    tried = written(_verified(at_hub.select("node", "hub").distinct(), wanted, least, size), files=files)
    # bands where some differ from their hub: their members are compared anew, in finer bands
    mixed = at_hub.join(tried.where("NOT alike").select("node", "hub"), ["node", "hub"], "left_semi").select("band").distinct()
    again = members.join(mixed, "band", "left_semi").select("node").distinct()
    fine = written(_finer(wanted.join(again, "node"), size), files=files)
    rows = _crowded(fine.select("node", F.explode("bands").alias("band")))
    fine_hub = written(_at_hubs(_with_standing(rows)), files=files)
    pairs = fine_hub.select("node", "hub").distinct()
    more = written(_verified(pairs.join(tried, ["node", "hub"], "left_anti"), wanted, least, size), files=files)
    # members of a fine band that links leave in pieces are compared with each other
    known = tried.union(more)
    found = known.where("alike").select("node", "hub").distinct()
    label = _joined(found, files)
    split = _in_pieces(rows.select("band", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    split = written(split, files=files)
    near = written(_near(split.join(fine.select("node", "sketch", "bands"), "node"), least), files=files)
    close = near.join(split, ["band", "node"]).join(fine.select("node", "sketch"), "node").join(wanted, "node")
    out = written(found.union(_closest(close, least, size)).distinct(), files=files)
    for t in (members, at_hub, tried, fine, fine_hub, more, wanted, near, split, label):
        forget(t)
    return out


def _fewer(edges: DataFrame) -> DataFrame:
    """Edges (node, hub) with the same components, and no more of them: a node stays at its
    least hub alone, and its other hubs go to that one. As members of a large group share
    their hubs, about one edge a member is left of one for each of its bands."""
    least = edges.groupBy("node").agg(F.min("hub").alias("first"))
    other = edges.join(least, "node").where("hub <> first").select(F.col("hub").alias("node"), F.col("first").alias("hub"))
    return least.withColumnRenamed("first", "hub").union(other.distinct())


def classes(edges: DataFrame, names: DataFrame, files: int | None = None) -> DataFrame:
    """node, label: the least name in each connected component of edges (node, hub).

    names: node, name. Each round a node takes the least label beside it, then the label
    of its label, so the rounds needed grow with the logarithm of a component's width."""
    edges = _fewer(edges)
    both = written(edges.union(edges.select("hub", "node")).toDF("a", "b").distinct(), files=files)
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = written(names.join(ends, "node").select("node", F.struct("name", "node").alias("label")), files=files)
    while True:
        beside = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(beside, labels.node == beside.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        near = written(near, files=files)
        over = near.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = written(near.join(over, near.label.node == over["at"]).select("node", F.least("label", "beyond").alias("label"), (F.least("label", "beyond") != F.col("was")).alias("moved")), files=files)
        still = new.where("moved").isEmpty()
        forget(near)
        forget(labels)
        labels = new
        if still:
            forget(both)
            return labels


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (a hash of the raw text), class_id and class_mark (the least doc_id of the
    class, and the mark of its text), n_copies (rows of equal words), kept: true for one row of
    each class. Where ids are not unique, class_id and class_mark together name a class.

    Where a row that stands for its class is repeated whole, id and text, one of its repeats
    is kept and the others are not. A row without words or without doc_id is its own class."""
    ensure_importable(docs.sparkSession)
    files = few_files(docs)
    sig = written(signatures(docs, bands, rows, size))
    edges = links(sig, docs, least, size)
    texts = sig.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.count(F.lit(1)).alias("n_copies"))
    names = texts.select("node", F.col("at").alias("name"))
    label = classes(edges, names, files)
    about = texts.join(label, "node", "left").select("node", "at", "n_copies", F.coalesce("label.name", "at").alias("class"), F.coalesce(F.col("label.node"), F.col("node")).alias("top"))
    own = F.col("node").isNull() | F.col("doc_id").isNull()
    stands = (F.col("top") == F.col("node")) & (F.col("at.doc_id") == F.col("doc_id")) & (F.col("at.mark") == F.col("mark"))
    out = sig.select("doc_id", "mark", "node").join(about, "node", "left")
    alone = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"class.{c}")).alias(f"class_{c.removeprefix('doc_')}")
    out = out.select("doc_id", "mark", alone("doc_id"), alone("mark"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), own.alias("own"), (own | stands).alias("kept"), F.monotonically_increasing_id().alias("number"))
    out = written(out, files)
    # a row that is repeated whole stands for its class once
    again = out.where("kept AND NOT own").groupBy("doc_id", "mark").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "mark", "first")
    found = out
    if not again.isEmpty():
        found = out.join(again, ["doc_id", "mark"], "left").withColumn("kept", F.col("kept") & (F.col("first").isNull() | (F.col("first") == F.col("number"))))
    found = found.select("doc_id", "mark", "class_id", "class_mark", "n_copies", "kept")
    for t in (sig, edges, label):
        forget(t)
    return found


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """docs, with one row of each class of near duplicates. Rows without doc_id stay."""
    found = near_duplicates(docs, **params)
    key = [F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")]
    mark = F.xxhash64(F.col("text").cast("string"))

    def matching(rows, how):
        at = rows.select(*key)
        return docs.join(at, (docs["doc_id"].cast("long") == at["_gone_id"]) & (mark == at["_gone_mark"]), how)

    rows = found.where("doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("stay"))
    left = matching(rows.where("stay < n"), "left_anti")
    again = rows.where("kept AND stay < n")
    if again.isEmpty():
        return left
    # rows that repeat id and text: one of them stays
    place = [c.lower() for c in docs.columns].index("doc_id")
    names = [f"c{i}" for i in range(len(docs.columns))]
    one = matching(again, "left_semi").toDF(*names).withColumn("mark", F.xxhash64(F.col(names[[c.lower() for c in docs.columns].index("text")]).cast("string")))
    one = one.groupBy(F.col(names[place]).cast("long").alias("id"), "mark").agg(F.first(F.struct(*names)).alias("row"))
    return left.unionByName(one.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)]))
