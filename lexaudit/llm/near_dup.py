"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation, components.

Method
------
A document is the set of its distinct n-word shingles. Rows with the same set form a class, which has a number of its own
and a row with its smallest doc_id. Classes that share a doc_id are linked. Each class gets a signature of ``POSITIONS`` b-bit minima (b = 16); two signatures
are at distance D if they differ in D positions. The signature is split into ``CHUNKS`` chunks, and every chunk
is entered once for each choice of ``ERRORS`` positions left out. By the pigeonhole principle two signatures with
D <= ``MAX_DISTANCE`` have a chunk with at most ``ERRORS`` differing positions, so they meet in a bucket: no pair
within the distance is lost. Two sets of similarity 0.8 differ in 20 of 100 positions on average and exceed 39 with
a probability of about 4e-6, which falls to 1e-9 at 0.85.

Buckets are not expanded into all pairs. (1) Each member meets its bucket's smallest member; the pairs within the
distance span families. (2) Members of one bucket that lie in different families meet each other: in a bucket of up to
``BUCKET_PAIRS`` members by a join; in a larger one block by block, where those outside its largest family meet all others and
a block gives at most one pair within the distance less than it has families. Families that such pairs connect become one.
(3) Each member's closest pair and the pairs of (2) are confirmed on the full shingle sets, which gives components. (4) In a
family that still has several components, every member outside the largest meets all members outside its own component, block
by block, on full sets, and only confirmed links leave a task. Pairs inside a component need no look, so no link between
different components is lost.

Defined results: null text, or no word: n_shingles 0, linked with nothing, kept. Null doc_id: component_id null,
kept. Rows that repeat a doc_id are one node, also if their texts
differ: the links of each text are the node's, and a row without a word goes with the others. An empty table gives an empty table. Extra columns are ignored.
A very long text is hashed whole, in one task (README has its memory).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import U64, mix, shingle_hashes, text_blocks, word_hashes
from .storage import Workspace

CHUNKS, WIDTH, ERRORS = 20, 5, 1
POSITIONS = CHUNKS * WIDTH
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: A side of a confirmation block holds about so many sets and so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Members of a bucket that are joined pair by pair at most, and those on a side of a block of a larger bucket.
BUCKET_PAIRS, BUCKET_BLOCK = 64, 4_096
#: Ids of documents whose texts are read again are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(77)
_MULT = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) | U64(1)
_XOR = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64)
_WILDCARDS = [[i for i in range(WIDTH) if i != w] for w in range(WIDTH)]
_SKETCH_WORDS = (POSITIONS + 15) // 16


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS minima of 16 bits."""
    best = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None]
        np.minimum(best, ((part ^ _XOR) * _MULT).min(axis=0), out=best)
    return (mix(best) >> U64(48)).astype("<u2")


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each position, 16 positions in a long: differing positions of these bound the distance from below."""
    padded = np.zeros((len(sig), _SKETCH_WORDS * 16), dtype=np.uint64)
    padded[:, :POSITIONS] = sig & 15
    shifts = np.arange(16, dtype=np.uint64) * U64(4)
    return (padded.reshape(len(sig), _SKETCH_WORDS, 16) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _fingerprints(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two sums over each set, which with its size stand for it."""
    fa = [int(s.sum(dtype=np.uint64)) for s in sets]
    fb = [int(mix(s ^ U64(0xA5A5A5A5)).sum(dtype=np.uint64)) for s in sets]
    return pa.array(np.array(fa, np.uint64).view(np.int64)), pa.array(np.array(fb, np.uint64).view(np.int64))


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_blocks(batch, "text"):
                words, offsets = word_hashes(texts)
                sets = list(shingle_hashes(words, offsets, n))
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), *_fingerprints(sets), pa.array(sigs, pa.binary())],
                    names=["id", "n", "fa", "fb", "sig"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), POSITIONS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk and each left-out position of a representative's signature."""
    for batch in batches:
        if not len(batch):
            continue
        sig = _matrix(batch.column("sig")).astype(np.uint64).reshape(len(batch), CHUNKS, WIDTH)
        keys = np.empty((len(batch), CHUNKS, WIDTH), dtype=np.uint64)
        for w, rest in enumerate(_WILDCARDS):
            packed = sum(sig[:, :, p] << U64(16 * i) for i, p in enumerate(rest))
            keys[:, :, w] = mix(mix(packed) + (np.arange(CHUNKS, dtype=np.uint64) * U64(WIDTH) + U64(w)) * U64(0x9E3779B97F4A7C15))
        ids = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), CHUNKS * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "rep"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            d = (_matrix(batch.column("sa")) != _matrix(batch.column("sb"))).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d.astype(np.int32))], names=["a", "b", "d"])
            yield out.filter(pa.array(d <= MAX_DISTANCE))


def _add_nibbles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            s = _nibbles(_matrix(batch.column("sig")))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), *(pa.array(s[:, k]) for k in range(_SKETCH_WORDS))], names=["rep", "n", *(f"s{k}" for k in range(_SKETCH_WORDS))])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_blocks(batch, "text"):
                words, offsets = word_hashes(texts)
                sets = list(shingle_hashes(words, offsets, n))
                fa, fb = _fingerprints(sets)
                yield pa.RecordBatch.from_arrays([fa, fb, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fa", "fb", "n", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int):
    """Confirmed links of the probe rows of a block with its other rows of another component, one for each pair of components."""

    def run(table: pa.Table) -> pa.Table:
        probe = np.array(table["probe"].to_pylist(), dtype=bool)
        label = table["component"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
        rest = np.flatnonzero(~probe)
        sizes = np.array([len(sets[i]) for i in rest], dtype=np.int64)
        links = set()
        if len(rest):
            pool, owner = np.concatenate([sets[i] for i in rest]), np.repeat(np.arange(len(rest)), sizes)
            order = np.argsort(pool)
            pool, owner = pool[order], owner[order]
            for p in np.flatnonzero(probe):
                lo, hi = np.searchsorted(pool, sets[p], "left"), np.searchsorted(pool, sets[p], "right")
                runs = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                both = np.bincount(owner[at], minlength=len(rest))
                hit = (100 * both >= percent * (sizes + len(sets[p]) - both)) & (label[rest] != label[p])
                links |= {(int(label[p]), int(x)) for x in np.unique(label[rest[hit]])}
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _bridges(percent: int):
    """Pairs within the distance that connect the families of a block, at most one less than there are families: of the probe rows and its other rows."""

    def run(table: pa.Table) -> pa.Table:
        probe = np.array(table["probe"].to_pylist(), dtype=bool)
        rep, family, n = (table[c].to_numpy() for c in ("rep", "family", "n"))
        sig, rest = _matrix(table["sig"]), np.flatnonzero(~probe)
        root, links = {}, []

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for p in np.flatnonzero(probe):
            near = rest[(family[rest] != family[p]) & (100 * np.minimum(n[rest], n[p]) >= percent * np.maximum(n[rest], n[p]))]
            d = (sig[near] != sig[p]).sum(axis=1)
            near = near[np.argsort(d, kind="stable")[: np.count_nonzero(d <= MAX_DISTANCE)]]
            for q in near[np.unique(family[near], return_index=True)[1]]:  # the closest row of each family
                x, y = find(int(family[p])), find(int(family[q]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((p, q))
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": rep[a], "b": rep[b], "fa": family[a], "fb": family[b]})

    return run


def _pairs_with(pairs: DataFrame, side: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    for key, name in zip("ab", names):
        pairs = pairs.join(side.select(F.col("rep").alias(key), F.col(value).alias(name)), key)
    return pairs


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    ws = Workspace(docs.sparkSession, "near-dup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = ws.save(source.mapInArrow(_sketcher(shingle_words), "id long, n long, fa long, fb long, sig binary"), "sketch")
    classes = sketch.where("id is not null and n > 0").groupBy("fa", "fb", "n").agg(F.min(F.struct("id", "sig")).alias("m"))
    classes = ws.save(classes.select("fa", "fb", "n", F.col("m.id").alias("first_id"), F.col("m.sig").alias("sig"), F.monotonically_increasing_id().alias("rep")), "classes")
    reps = classes.select("rep", "n", "sig")
    small = lambda table: F.broadcast(table) if table.count() <= BROADCAST_IDS else table
    # ids whose rows differ: their classes are one node
    differing = sketch.where("id is not null").groupBy("id").agg(F.min(F.struct("fa", "fb", "n")).alias("lo"), F.max(F.struct("fa", "fb", "n")).alias("hi")).where("lo <> hi").select("id")
    differing = ws.save(differing, "differing")
    split_ids = ws.save(sketch.where("n > 0").join(small(differing), "id", "left_semi").select("id", "fa", "fb", "n").distinct().join(classes.select("fa", "fb", "n", "rep"), ["fa", "fb", "n"]).select("id", "rep"), "split-ids")
    heads = ws.save(split_ids.groupBy("id").agg(F.min("rep").alias("head")), "heads")
    same_id = split_ids.join(small(heads), "id").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))

    keys = lambda: reps.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    shared = keys().groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("leader")).where("members > 1")
    buckets = ws.save(keys().join(shared, "key"), "buckets")

    similar_size = "100L * least(na, nb) >= {p}L * greatest(na, nb)".format(p=percent)
    sized = reps.select("rep", F.struct("n", "sig").alias("r"))
    near = lambda pairs: _pairs_with(pairs, sized, "r", ("ra", "rb")).select("a", "b", F.col("ra.n").alias("na"), F.col("rb.n").alias("nb"), F.col("ra.sig").alias("sa"), F.col("rb.sig").alias("sb")).where(similar_size).drop("na", "nb").mapInArrow(_distances, "a long, b long, d int")
    stars = ws.save(near(buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()), "stars")
    families = ws.save(connected_components(stars, ws, "family"), "families").select(F.col("node").alias("rep"), F.col("component").alias("family"))

    placed = buckets.where("members > 2 and rep <> leader").select("key", "rep").join(families, "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    mixed = placed.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count("*").alias("placed")).where("lo <> hi").select("key", "placed")
    mixed = ws.save(placed.join(mixed, "key"), "mixed")
    across = ws.save(mixed.where(F.col("placed") <= BUCKET_PAIRS).drop("placed").join(reps.select("rep", "n", "sig").mapInArrow(_add_nibbles, "rep long, n long, " + ", ".join(f"s{k} long" for k in range(_SKETCH_WORDS))), "rep"), "across")
    x, y = across.alias("x"), across.alias("y")
    differ = lambda k: f"(x.s{k} ^ y.s{k})"
    folded = lambda k: f"({differ(k)} | shiftrightunsigned({differ(k)}, 1) | shiftrightunsigned({differ(k)}, 2) | shiftrightunsigned({differ(k)}, 3))"
    apart = " + ".join(f"bit_count({folded(k)} & 1229782938247303441L)" for k in range(_SKETCH_WORDS))
    met = x.join(y, F.expr(f"x.key = y.key and x.rep < y.rep and x.family <> y.family and 100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n) and {apart} <= {MAX_DISTANCE}"))
    crossing = near(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    crowd = mixed.where(F.col("placed") > BUCKET_PAIRS)
    per_family = crowd.groupBy("key", "family").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "family")).alias("m"), F.sum("c").alias("c"))
    in_blocks = lambda c: F.ceil(c / BUCKET_BLOCK).cast("int")
    crowd = crowd.join(per_family.select("key", F.col("m.family").alias("main"), in_blocks(F.col("c")).alias("all_blocks"), in_blocks(F.col("c") - F.col("m.c")).alias("probe_blocks")), "key").join(reps, "rep")
    row = ["key", "rep", "family", "n", "sig"]
    probes = crowd.where("family <> main").select(*row, F.lit(True).alias("probe"), own("probe_blocks").alias("pb"), every("all_blocks").alias("ab"))
    others = crowd.select(*row, F.lit(False).alias("probe"), own("all_blocks").alias("ab"), every("probe_blocks").alias("pb")).select(*row, "probe", "pb", "ab")
    bridges = ws.save(probes.union(others).groupBy("key", "pb", "ab").applyInArrow(_bridges(percent), "a long, b long, fa long, fb long"), "bridges")
    joined = connected_components(bridges.select(F.col("fa").alias("a"), F.col("fb").alias("b")), ws, "bridge").select(F.col("node").alias("family"), F.col("component").alias("whole"))
    alone = bridges.select(F.explode(F.array("fa", "fb")).alias("rep")).select("rep", F.col("rep").alias("family"))
    families = families.union(alone).distinct().join(joined, "family", "left").select("rep", F.coalesce("whole", "family").alias("family"))
    families = ws.save(families, "whole-families")
    closest = stars.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    pairs = ws.save(closest.union(crossing.select("a", "b")).union(bridges.select("a", "b").distinct()), "pairs")
    ws.drop("across", "mixed", "buckets", "bridges", "families")

    involved = stars.select(F.explode(F.array("a", "b")).alias("rep")).union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    involved = ws.save(classes.join(involved, "rep", "left_semi").select("rep", "fa", "fb", "n", F.col("first_id").alias("id")), "involved")
    ws.drop("stars")
    # a text is read by the smallest doc_id of its class; a row of that id with another text has other sums
    texts = source.join(small(involved.select("id").distinct()), "id", "left_semi")
    sets = texts.mapInArrow(_sets(shingle_words), "fa long, fb long, n long, shingles binary").dropDuplicates(["fa", "fb", "n"])
    sets = ws.save(sets.join(involved.select("rep", "fa", "fb", "n"), ["fa", "fb", "n"]).select("rep", "shingles"), "sets")
    links = _pairs_with(pairs, sets, "shingles", ("xa", "xb")).mapInArrow(_confirm(percent), "a long, b long")
    first = ws.save(connected_components(links, ws, "first"), "first-labels")

    ws.drop("pairs", "involved")
    members = families.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = ws.save(members.join(reps.select("rep", "n"), "rep"), "members")
    per_label = members.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(F.sum(c) / BLOCK_SETS, F.sum(s) / BLOCK_SHINGLES)).cast("int")
    split = per_label.groupBy("family").agg(F.max(F.struct("c", (-F.col("component")).alias("k"))).alias("m"), F.count("*").alias("labels"), blocks("c", "s").alias("all_blocks")).where("labels > 1").select("family", (-F.col("m.k")).alias("main"), "all_blocks")
    outside = per_label.join(split, "family").where("component <> main").groupBy("family").agg(blocks("c", "s").alias("probe_blocks"))
    rows = members.join(split.join(outside, "family"), "family").join(sets, "rep")
    probes = rows.where("component <> main").select("family", "component", "shingles", F.lit(True).alias("probe"), own("probe_blocks").alias("pb"), every("all_blocks").alias("ab"))
    others = rows.select("family", "component", "shingles", F.lit(False).alias("probe"), own("all_blocks").alias("ab"), every("probe_blocks").alias("pb")).select("family", "component", "shingles", "probe", "pb", "ab")
    more = probes.union(others).groupBy("family", "pb", "ab").applyInArrow(_block_links(percent), "a long, b long")
    second = connected_components(more, ws, "second").select(F.col("node").alias("component"), F.col("component").alias("root"))
    ws.drop("whole-families", "sets")
    labels = first.select(F.col("node").alias("rep"), "component").union(members.select("rep", "component")).distinct().join(second, "component", "left").select("rep", F.coalesce("root", "component").alias("root"))
    labels = ws.save(labels, "labels")
    # a class of a differing id may have no other link; components meet at the labels of its classes
    met = same_id
    for end in "ab":
        met = met.join(labels.select(F.col("rep").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    third = connected_components(met.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), ws, "third").select(F.col("node").alias("root"), F.col("component").alias("top"))

    owner = classes.select("fa", "fb", "n", "rep", "first_id").join(labels, "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(third, "root", "left").withColumn("root", F.coalesce("top", "root"))
    owner = ws.save(owner.select("fa", "fb", "n", "rep", "first_id", "root"), "owner")
    least = ws.save(owner.groupBy("root").agg(F.min("first_id").alias("c"), F.count("*").alias("classes")).where("classes > 1").select("root", "c"), "least")
    owner = owner.join(small(least), "root", "left").select("fa", "fb", "n", "rep", F.coalesce("c", "first_id").alias("c"))
    wordless = heads.join(owner.select(F.col("rep").alias("head"), F.col("c").alias("of_id")), "head").select("id", "of_id")
    out = sketch.select("id", "n", "fa", "fb").join(owner.drop("rep"), ["fa", "fb", "n"], "left").join(F.broadcast(wordless) if heads.count() <= BROADCAST_IDS else wordless, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "of_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
