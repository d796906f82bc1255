"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's shingles are its runs of five words (a text of fewer words is one
shingle; a text without words has none), each of weight 1. Each shingle sends
arrivals of a Poisson process whose rate is its weight; every arrival falls on
a random register, which keeps the shingle that came first. Two registers agree
with the probability Jaccard of the weighted sets, which for weights of 1 is
the Jaccard that links are verified by, so repetition costs no candidate. A
shingle stops as soon as its next arrival is later than all registers.

Registers are banded (``bands`` x ``rows``); texts that share a band are
candidates. Candidates are verified by the exact Jaccard of their shingle
sets, and classes are the connected components of the verified pairs.

No pairs are emitted within a bucket: every member is compared with the
bucket's hub, the member that shares most with others. Members that then lie
outside of the hub's component are a query set against the others, in blocks of
``BLOCK``: a task compares two blocks and gives only the links it finds, so no
candidate link between components is lost. What they are compared with is, for
each component, the smaller work of two: the members of each bucket that they
share (buckets of equal members once), or all members of the component once.
Equal texts are one node from the start.

Nodes are 64-bit hashes of texts. Where different texts have the same one, which
a second hash tells, all but one of them take that second hash. Shingles are
48-bit hashes: two of n in a pair of texts are taken for equal with a
probability of n * n / 2^49.

Defined results: a null text is alone in its class; texts without words share
a class only with equal texts; repeated rows share a class, of which ``kept``
is true for one row; a null doc_id sorts last; a class without any doc_id has
a null class_id. ``near_duplicates`` returns its own five columns,
``deduplicated`` the columns of its input as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_words import flat_words, fresh, mix, ranges, slices, word_hashes
from .storage import written

SHINGLE = 5
BANDS, ROWS = 50, 7
BROADCAST_ROWS = 1_000_000
HUB_PART = BLOCK = 256
SLICE, LEAST = 3 << 19, 1024  # bytes of texts that are signed at a time, and of a text at least
_LOW48 = np.uint64((1 << 48) - 1)
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 48-bit shingle, occurrences), sorted by text and shingle. At most 65,536 texts."""
    codes, words, bounds = flat_words(texts)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = mix(word_hashes(words) + _M)[codes]
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    with np.errstate(over="ignore"):
        run = h.copy()
        upto = np.minimum(size, lengths)[doc]  # words of a shingle that starts here
        left = bounds[1:][doc] - np.arange(len(h))
        for k in range(1, size):
            inside = (left > k) & (upto > k)
            nxt = np.zeros_like(h)
            nxt[:-k or None] = h[k:]
            run = np.where(inside, mix(run * _M + nxt), run)
    starts = left >= upto
    # a text shorter than a shingle has only the one that starts at its first word
    key = np.sort((doc[starts].astype(np.uint64) << np.uint64(48)) | (run[starts] & _LOW48))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first] >> np.uint64(48)).astype(np.int64), key[first] & _LOW48, np.diff(np.append(first, len(key)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures (n_docs x registers): the element that arrived first on each register."""
    soonest = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    time, turn = np.zeros(len(element)), 0
    with np.errstate(over="ignore"):
        while len(element):
            turn += 1
            bits = mix(element * _M + np.uint64(turn))
            time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            going = time < latest[doc]
            doc, element, weight, time, bits = doc[going], element[going], weight[going], time[going], bits[going]
            at = doc * registers + (mix(bits ^ _M) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(soonest, at, time)
            won = soonest[at] == time
            winner[at[won]] = element[won]
            if turn < 16 or turn % 8 == 0:  # an old bound only costs time
                own = np.unique(doc)
                latest[own] = soonest.reshape(n_docs, registers)[own].max(axis=1)
    return winner.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
        for r in range(rows):
            out = mix(out * _M + signature.reshape(-1, bands, rows)[:, :, r])
    return out


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE, LEAST):
            doc, element, _ = shingles(batch.column("text"))
            has, count = np.unique(doc, return_counts=True)
            if not len(has):
                continue
            sig = prob_minhash(np.searchsorted(has, doc), element, np.ones(len(element)), len(has), bands * rows)
            flat = pa.array(band_hashes(sig, bands, rows).ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(has)), pa.array(count, pa.int32()), lists], ["node", "n_shingles", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE, LEAST):
        doc, element, _ = shingles(batch.column("text"))
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(element.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "shingles"])


def _narrow(df: DataFrame, n: int) -> DataFrame:
    """A broadcast hint for a table of few rows; a larger one is shuffled."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes."""
    own = texts.join(_narrow(nodes, nodes.count()), "node", "left_semi").mapInArrow(_sets, "node long, shingles array<long>")
    return written(own.dropDuplicates(["node"]), "sets")


def verified(texts: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard of ``threshold`` at least.

    b may be a hub of any number of pairs: its set is copied once for every
    ``HUB_PART`` of them, so no task gets all pairs of a hub.
    """
    pairs = written(pairs, "pairs")
    sets = shingle_sets(texts, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("parts"))
    dealt = pairs.join(hubs, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    right = hubs.join(sets.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    both = dealt.select("a", "b", "part").join(left, "a").join(right, ["b", "part"])
    inter = F.size(F.array_intersect("left", "right"))
    total = F.size("left") + F.size("right")
    # inter / (total - inter) >= p / q  in whole numbers
    close = inter * (threshold.numerator + threshold.denominator) >= threshold.numerator * total
    return both.where(close).select("a", "b")


def _block_links(p: int, q: int):
    """Links between the nodes of two blocks that have different labels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = right.column("shingles").combine_chunks()
        flat, size = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
        order = np.argsort(flat, kind="stable")
        ordered, owner = flat[order], np.repeat(np.arange(len(size)), size)[order]
        node, label = right.column("node").to_numpy(), right.column("label").to_numpy()
        found_a, found_b = [], []
        for x in left.to_pylist():
            own = np.asarray(x["shingles"], np.int64)
            first = np.searchsorted(ordered, own)
            shared = np.bincount(owner[ranges(first, np.searchsorted(ordered, own, side="right") - first)], minlength=len(size))
            close = (shared * (p + q) >= p * (size + len(own))) & (label != x["label"])
            found_b += node[close].tolist()
            found_a += [x["node"]] * int(close.sum())
        return pa.table([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return run


def arenas(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """(arena, node, label, out): whom the members outside of a hub's component are compared with.

    ``placed``: (band, node, label, home) of all members of the bands. In an
    arena every node with ``out`` meets all others. Where a home's bands together
    ask for fewer comparisons than its whole component, each of them is an arena.
    """
    named = placed.withColumn("out", F.col("label") != F.col("home"))
    sign = (F.count("*").alias("n"), F.sum(F.col("out").cast("long")).alias("n_out"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"))
    bands = named.groupBy("band", "home").agg(*sign).where("n_out > 0").groupBy("home", "n", "n_out", "s1", "s2").agg(F.min("band").alias("band"))
    bands = written(bands, "bands")
    outside = written(named.where("out").select("node", "label", "home").distinct(), "outside")
    homes = outside.select("home").distinct()
    members = labels.join(homes, labels["label"] == homes["home"]).select("node", "label", "home")
    alone = homes.select(F.col("home").alias("node"), F.col("home").alias("label"), "home")  # a hub without links
    whole = written(members.unionByName(alone).unionByName(outside).distinct(), "whole")
    work = bands.groupBy("home").agg(F.sum(F.col("n") * F.col("n_out")).alias("by_band"))
    work = work.join(whole.groupBy("home").agg((F.count("*") * F.sum((F.col("label") != F.col("home")).cast("long"))).alias("at_once")), "home")
    work = written(work.select("home", (F.col("by_band") < F.col("at_once")).alias("split")), "work")
    at_once = whole.join(work.where("not split"), "home").select(F.xxhash64(F.lit(0), "home").alias("arena"), "node", "label", (F.col("label") != F.col("home")).alias("out"))
    chosen = bands.join(work.where("split"), "home").select("band")
    by_band = named.join(chosen, "band").select(F.xxhash64(F.lit(1), "band").alias("arena"), "node", "label", "out")
    return written(at_once.unionByName(by_band), "arenas")


def outside_links(texts: DataFrame, arenas: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) of the nodes with ``out`` with all nodes of their arenas."""
    sets = shingle_sets(texts, arenas.select("node").distinct())
    sizes = arenas.groupBy("arena").agg(F.ceil(F.sum(F.col("out").cast("long")) / BLOCK).cast("int").alias("nx"), F.ceil(F.count("*") / BLOCK).cast("int").alias("ny"))
    sizes = written(sizes, "sizes")

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        """Every row in its own block, once for each block of the other side."""
        df = df.join(sizes, "arena").withColumn(own, F.pmod(F.xxhash64("node"), F.col(own_n)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return df.select("arena", "x", "y", "node", "label").join(sets.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select(*(F.col(c).alias(c) for c in ("arena", "x", "y", "node", "label", "shingles")))

    left, right = dealt(arenas.where("out"), "x", "nx", "y", "ny"), dealt(arenas, "y", "ny", "x", "nx")
    key = ["arena", "x", "y"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_links(threshold.numerator, threshold.denominator), "a long, b long")
    return written(found.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node of its component.

    Labels of neighbours spread, then labels take the label of their label, so
    the rounds grow with the logarithm of a component's diameter.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("up"))
        new = written(step.join(up, "to").select("node", F.least("to", "up").alias("label"), (F.least("to", "up") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def near_duplicate_nodes(texts: DataFrame, threshold: Fraction, bands: int, rows: int) -> DataFrame:
    """(node, label) of the texts that are near duplicates of another; ``texts``: node long, text string."""
    signed = texts.where("text is not null").mapInArrow(_signed(bands, rows), "node long, n_shingles int, bands array<long>")
    signed = written(signed.dropDuplicates(["node"]), "signatures")
    each = signed.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(each.join(shared, "band"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    hubs = members.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("central", "node")).alias("b"), F.max_by("n_shingles", F.struct("central", "node")).alias("b_shingles"))
    hubs = written(hubs, "hubs")
    p, q = threshold.numerator, threshold.denominator
    near = lambda x, y: (F.least(x, y) * q >= F.greatest(x, y) * p)  # noqa: E731  else the sizes rule it out
    pairs = members.join(hubs, "band").where("node <> b").where(near(F.col("n_shingles"), F.col("b_shingles"))).select(F.col("node").alias("a"), "b").distinct()
    edges = written(verified(texts, pairs, threshold), "verified")
    labels = components(edges)

    placed = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    homes = hubs.join(labels, hubs["b"] == labels["node"], "left").select("band", F.coalesce("label", "b").alias("home"))
    placed = written(placed.join(homes, "band"), "placed")
    if not placed.where("label <> home").limit(1).count():
        return labels
    more = outside_links(texts, arenas(placed, labels), threshold)
    return components(edges.unionByName(more)) if more.limit(1).count() else labels


def node_of(text: str, clashes: dict[int, int]) -> Column:
    """The node of each text. ``clashes``: first hashes of texts that differ, and the second hash of the one that keeps it."""
    node, second = F.xxhash64(text), _second(text)
    for h, s in clashes.items():
        node = F.when((F.xxhash64(text) == h) & (second != s), second).otherwise(node)
    return F.when(F.col(text).isNotNull(), node)


def _second(text: str) -> Column:
    return F.xxhash64(F.lit("second"), F.col(text))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id (the least doc_id of the class), class_size and kept."""
    return _classes(docs, doc_id, text, threshold, bands, rows)[0]


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, dict[int, int]]:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashes = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("h"), _second("text").alias("s")))
    ids = written(docs.select("doc_id", hashes.alias("node"), F.monotonically_increasing_id().alias("row")), "ids")
    twice = ids.where("node is not null").groupBy("node.h").agg(F.min("node.s").alias("s"), F.max("node.s").alias("t")).where("s <> t")
    clashes = {r.h: r.s for r in twice.collect()}  # n * n / 2^65 of them among n texts
    kept_first = F.lit(True)
    for h, s in clashes.items():
        kept_first = kept_first & ~((F.col("node.h") == h) & (F.col("node.s") != s))
    ids = ids.withColumn("node", F.when(kept_first, F.col("node.h")).otherwise(F.col("node.s")))
    texts = docs.select(node_of("text", clashes).alias("node"), "text")
    labels = near_duplicate_nodes(texts, Fraction(str(threshold)), bands, rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    counted = ids.where("node is not null").groupBy("node").agg(first.alias("first"), F.count("*").alias("n"))
    counted = counted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = counted.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    named = counted.select("node", "label").join(classes, "label").select("node", "first", "class_size")
    out = ids.join(written(named, "classes"), "node", "left")
    alone = F.col("node").isNull()
    found = out.select(
        "doc_id",
        "node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
    )
    return found, clashes


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id.

    Only rows that go, or that equal another in doc_id and text, are looked up
    by key; all others stay where they are.
    """
    found, clashes = _classes(docs, doc_id, text, threshold, BANDS, ROWS)
    out = written(found, "decisions")
    key = [fresh("_id", docs.columns), fresh("_node", docs.columns)]
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    named = docs.withColumn(key[1], node_of(text, clashes)).withColumn(key[0], as_text(doc_id))
    marks = out.where("node is not null").select(as_text("doc_id").alias(key[0]), F.col("node").alias(key[1]), F.col("kept").alias("keep"))
    marks = marks.groupBy(*key).agg(F.bool_or("keep").alias("keep"), F.count("*").alias("times"))
    marks = written(marks.where("not keep or times > 1"), "marks")
    marked, again = _narrow(marks.select(key), marks.count()), marks.where("keep")
    here = named.where(F.col(text).isNotNull())
    stay = named.where(F.col(text).isNull()).unionByName(here.join(marked, key, "left_anti").select(named.columns))
    one = here.join(_narrow(again.select(key), again.count()), key, "left_semi").dropDuplicates(key).select(named.columns)
    return stay.unionByName(one).select(docs.columns)
