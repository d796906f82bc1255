"""Katz backoff scores of texts by an n-gram model of the corpus itself.

Counts of n-grams of every length up to ``order`` are Good-Turing discounted up
to ``LARGEST``; larger ones give up ``FLOOR`` of a count, so every history has
mass left. An n-gram that was never seen is backed off to the shorter one, with
the weight that makes the probabilities after each history sum to one; a word
that was never seen has what the discounts of single words leave. A seen n-gram
ends in a seen shorter one, so the weights of all lengths follow from counts.

Texts travel as blocks: a slice of a partition with its words as codes. A
block sends its distinct keys (56-bit hashes) with their training counts to
up to 2 ** ``PART_BITS`` parts of the key range and gets the totals of just these keys
back (``exchanged``). Where more than ``FAN`` blocks would meet in a part they
are first bundled: a bundle is a block of sums over a part of the range, which
sends to the parts of that part, and so on. So a task holds ``FAN`` messages of a
bounded size, messages grow in proportion to the input times the logarithm of
it, and a very common key comes once from each block or bundle. The totals are
the model's tables, written and partitioned by length and key range.

Of the blocks that send an n-gram the first by name adds its share to its
history's backoff weight, and these weights return to the blocks in the same
way. All sums are made in the order of blocks' names, in whole numbers or 64-bit
floats, so scores are equal on a rerun. The driver only sees counts of counts.

Blocks are read twice and told apart by a hash of their contents; an input
that changes between two reads raises an error rather than giving scores.

Defined results: a null text is empty and has the end token alone; repeated
rows are scored, and counted, each; a null ``held_out`` is false; ids keep the
type that they have, null too; with no training text every word is unknown, and
scores come from one word of mass 1; an empty table gives no rows. Columns other
than the id, the text and ``held_out`` aren't in the result, so their names
can't clash. Two n-grams among n have the same key with a probability of
n * n / 2^57, and then share their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow_words import flat_words, mix, slices, word_hashes
from .storage import written

LARGEST, FLOOR = 5, 0.01
BLOCK_BYTES = 8 << 20
PART_TOKENS = 2_000_000
FAN, PART_BITS = 512, 8
BITS = 56
_M = np.uint64(0x9E3779B97F4A7C15)
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # hashes of the end token and of the history before a text


def discounts(seen: list[int], largest: int = LARGEST) -> np.ndarray:
    """Factor of each count from 0 to ``largest``, from seen[r]: how many items occur r times.

    Katz's factors for Good-Turing counts. Where the counts of counts allow
    none between 0 and 1, that count gives up ``FLOOR``, as larger ones do.
    """
    out = np.ones(largest + 1)
    for r in range(1, largest + 1):
        out[r] = 1 - FLOOR / r
        if seen[1] and seen[r] and seen[r + 1]:
            over = (largest + 1) * seen[largest + 1] / seen[1]
            d = ((r + 1) * seen[r + 1] / (r * seen[r]) - over) / (1 - over) if over < 1 else 0
            if 0 < d < 1:
                out[r] = d
    return out


def kept_counts(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The discounted counts."""
    counts = counts.astype(np.float64)
    small = np.minimum(counts, len(factors) - 1).astype(np.int64)
    return np.where(counts < len(factors), counts * factors[small], counts - FLOOR)


class Model:
    """What all blocks need: discounts of each length, token and type counts, and the mass of unknown words."""

    def __init__(self, seen: list[list[int]]):
        """``seen``: of each length, the numbers of n-grams with counts 1 to LARGEST + 1, the number of n-grams, and the sum of their counts."""
        self.types, self.tokens = seen[0][-2:]
        self.factors = [discounts([0, *x[: LARGEST + 1]]) for x in seen]
        freed = sum(n * r * (1 - self.factors[0][r]) for r, n in enumerate(seen[0][:LARGEST], 1)) + FLOOR * (seen[0][-2] - sum(seen[0][:LARGEST]))
        self.unknown = freed / self.tokens if self.tokens else 1.0

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; these and that of an unknown word sum to one."""
        return np.where(counts > 0, kept_counts(counts, self.factors[0]) / max(1, self.tokens), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed; leading planes of zeros are left out."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    used = next((k for k in range(x.itemsize, 0, -1) if planes[k - 1].any()), 0)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    used, raw = blob[0], zstandard.ZstdDecompressor().decompress(blob[1:])
    if not used:
        raise ValueError("the length of zeros alone isn't known")
    planes = np.frombuffer(raw, np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :used] = planes.T
    return out.view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences; a last one keeps zeros from being alone."""
    return packed(np.append(np.diff(keys, prepend=np.uint64(0)), np.uint64(1)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8")[:-1], dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return packed(np.append(counts, 1).astype("<u8"))


def unpacked_counts(blob: bytes) -> np.ndarray:
    return unpacked(blob, "<u8")[:-1].astype(np.int64)


def packed_floats(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<f8").tobytes())


def unpacked_floats(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<f8")


class Block:
    """Texts as word codes. Two codes follow those of the words: the end token and the history before a text."""

    def __init__(self, codes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, held: np.ndarray):
        n, words = len(bounds) - 1, len(hashes)
        self.codes, self.hashes, self.bounds, self.held = codes, hashes, bounds, held
        self.every = np.concatenate([hashes, [_END, _START]])
        doc = np.repeat(np.arange(n), np.diff(bounds))
        self.token = np.full(len(codes) + n, words, np.int64)
        self.token[np.arange(len(codes)) + doc] = codes
        self.first = bounds[:-1] + np.arange(n)
        self.doc = np.repeat(np.arange(n), np.diff(bounds) + 1)
        self.train = ~held[self.doc]
        self._grams, self._begin = self.every[self.token], _START  # hashes of the n-grams that end at each token; that before a text

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        codes, words, bounds = flat_words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
        return cls(codes.astype(np.int64), mix(word_hashes(words)), bounds, batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool))

    def name(self, place: int) -> int:
        """A hash of the contents and of the place that the block has in its input."""
        h = xxhash.xxh3_64(place.to_bytes(8, "little"))
        for x in (self.codes, self.hashes, self.bounds, self.held):
            h.update(np.ascontiguousarray(x).tobytes())
        return h.intdigest() >> 1

    def levels(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]]:
        """Of each length: (sorted distinct keys, a token that ends each, the key of each token, the key of what stands before a text)."""
        shift, grams, begin = np.uint64(64 - BITS), self._grams, self._begin
        for level in range(1, order + 1):
            if level == 1:
                unique, inverse = np.unique(self.every[:-1] >> shift, return_inverse=True)
                where = inverse[self.token]
                example = np.zeros(len(unique), np.int64)
                example[where] = np.arange(len(where))
                there = np.bincount(where, minlength=len(unique)) > 0
                if not there.all():  # a block without texts
                    unique, example, where = unique[there], example[there], (np.cumsum(there) - 1)[where]
                yield unique, example, where, begin >> shift
                continue
            with np.errstate(over="ignore"):
                history = np.empty_like(grams)
                history[1:] = grams[:-1]
                history[self.first] = begin
                grams = mix(history * _M + self.every[self.token])
                begin = mix(np.asarray([begin * _M + _START]))[0]
            yield *np.unique(grams >> shift, return_index=True, return_inverse=True), begin >> shift


def part_slices(keys: np.ndarray, prefix: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted keys: parts go by the first ``prefix`` bits."""
    if not len(keys):
        return
    part = (keys >> np.uint64(BITS - prefix)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(part)], strict=True):
        yield int(part[s]), int(s), int(e)


# Keys and values of a block or bundle in one part of the key range, or the totals that return; ``owned``: which keys it is the first to send.
# A row without a block is a part of the model: its keys, their totals, and the numbers of keys by total.
MESSAGE = "block long, level int, part long, keys binary, values binary, owned binary, seen array<long>"
_MESSAGE = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in ("keys", "values", "owned")), ("seen", pa.list_(pa.int64()))])


class Kind:
    """How values are packed and summed: whole counts, or pairs of floats (freed and taken mass) one behind the other."""

    def __init__(self, counts: bool):
        self.counts, self.width = counts, 1 if counts else 2

    def pack(self, x: np.ndarray) -> bytes:
        """``x``: width x keys."""
        return packed_counts(x[0]) if self.counts else packed_floats(x.ravel())

    def unpack(self, blob: bytes) -> np.ndarray:
        return (unpacked_counts(blob) if self.counts else unpacked_floats(blob)).reshape(self.width, -1)

    def merged(self, messages: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(distinct keys, their sums, for each message where its keys are among them, and which it is the first to send)."""
        keys = [unpacked_keys(m["keys"]) for m in messages]
        unique, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        values = np.concatenate([self.unpack(m["values"]) for m in messages], axis=1)
        sums = np.stack([np.bincount(inverse, v, len(unique)) for v in values])
        if self.counts:  # exact up to 2^53
            sums = sums.astype(np.int64)
        new = np.zeros(len(inverse), bool)
        new[first] = True
        cuts = np.cumsum([*map(len, keys)])[:-1]
        return unique, sums, np.split(inverse, cuts), np.split(new, cuts)


def _answer(kind: Kind, message: dict, totals: np.ndarray, owned: np.ndarray) -> dict:
    return {"block": message["block"], "level": message["level"], "part": message["part"], "values": kind.pack(totals), "owned": np.packbits(owned).tobytes()}


def _by_name(messages: pa.Table) -> list[dict]:
    return sorted(messages.to_pylist(), key=lambda m: (m["block"], m["part"]))


def _totalled(kind: Kind):
    """One part of a length: the totals of each block's keys and, of counts, the model's row."""

    def run(table: pa.Table) -> pa.Table:
        messages = _by_name(table)
        unique, sums, places, new = kind.merged(messages)
        out = [_answer(kind, m, sums[:, at], own) for m, at, own in zip(messages, places, new, strict=True)]
        if kind.counts:
            there = sums[0] > 0
            known = sums[0][there]
            seen = [*np.bincount(np.minimum(known, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2].tolist(), len(known), int(known.sum())]
            out.append({"block": None, "level": messages[0]["level"], "part": messages[0]["part"], "keys": packed_keys(unique[there]), "values": packed_counts(known), "seen": seen})
        return pa.Table.from_pylist(out, _MESSAGE)

    return run


def _bundled(kind: Kind, prefix: int):
    """A bundle's sums as messages to the parts of ``prefix`` bits."""

    def run(table: pa.Table) -> pa.Table:
        messages, bundle = _by_name(table.select(_MESSAGE.names)), table.column("bundle")[0].as_py()
        unique, sums, _, _ = kind.merged(messages)
        level = messages[0]["level"]
        return pa.Table.from_pylist([{"block": bundle, "level": level, "part": p, "keys": packed_keys(unique[s:e]), "values": kind.pack(sums[:, s:e])} for p, s, e in part_slices(unique, prefix)], _MESSAGE)

    return run


def _dealt(kind: Kind):
    """The totals that a bundle got, for the keys of each of its blocks."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        messages = _by_name(table.select(_MESSAGE.names))
        _, _, places, new = kind.merged(messages)
        totals, owned = joined_answers(kind, answers.to_pylist())
        return pa.Table.from_pylist([_answer(kind, m, totals[:, at], own & owned[at]) for m, at, own in zip(messages, places, new, strict=True)], _MESSAGE)

    return run


def joined_answers(kind: Kind, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(totals, owned) of a block's distinct keys of one length, in their order."""
    rows = sorted(rows, key=lambda r: r["part"])
    totals = [kind.unpack(r["values"]) for r in rows]
    owned = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=t.shape[1]).astype(bool) for r, t in zip(rows, totals, strict=True)]
    return np.concatenate([np.empty((kind.width, 0), np.int64 if kind.counts else np.float64), *totals], axis=1), np.concatenate([np.empty(0, bool), *owned])


def exchanged(sent: DataFrame, kind: Kind, blocks: int, bits: int, prefix: int) -> DataFrame:
    """The totals of the keys of each message, as messages to their blocks; of counts, the model's rows too.

    ``sent`` goes to parts of ``prefix`` bits of the key range; at most ``blocks`` messages go to a part.
    """
    if blocks <= FAN or prefix + bits > BITS:
        return sent.groupBy("level", "part").applyInArrow(_totalled(kind), MESSAGE)
    bundles = -(-blocks // FAN)
    sent = written(sent, "sent").withColumn("bundle", F.pmod(F.xxhash64("block"), F.lit(bundles)))
    key = ["level", "part", "bundle"]
    up = sent.groupBy(*key).applyInArrow(_bundled(kind, prefix + bits), MESSAGE)
    got = written(exchanged(up, kind, bundles, bits, prefix + bits), "totals", partition_by=["level"])
    answers = got.where("block is not null").withColumn("coarse", F.shiftright("part", bits))
    down = sent.groupBy(*key).cogroup(answers.groupBy("level", "coarse", "block")).applyInArrow(_dealt(kind), MESSAGE)
    return down.unionByName(got.where("block is null"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    place = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", BLOCK_BYTES):
        block = Block.of(batch)
        yield block.name(place), batch, block
        place += 1


def _sent(order: int, bits: int):
    """Blocks' distinct keys of all lengths with their training counts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, block in _blocks(batches):
            for level, (keys, _, inverse, _) in enumerate(block.levels(order), 1):
                counts = np.bincount(inverse[block.train], minlength=len(keys))
                rows = [{"block": name, "level": level, "part": p, "keys": packed_keys(keys[s:e]), "values": packed_counts(counts[s:e])} for p, s, e in part_slices(keys, bits)]
                yield pa.RecordBatch.from_pylist(rows, _MESSAGE)

    return run


CARRIED = "block long, ids array<{}>, held array<boolean>, bounds binary, codes binary, hashes binary"


def _carried(schema: pa.Schema):
    """Blocks as rows, to meet their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch, block in _blocks(batches):
            row = {
                "block": name,
                "ids": batch.column("doc_id").to_pylist(),
                "held": block.held.tolist(),
                "bounds": packed_counts(block.bounds),
                "codes": packed_counts(block.codes),
                "hashes": block.hashes.tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema)

    return run


# A block's texts without the weights of their histories: sums of each text, and which weights each backed-off token takes;
# or, with a level, the shares of the block's n-grams in the weights of a part of the histories.
SCORED = MESSAGE + ", ids array<{}>, held array<boolean>, sums binary, docs binary, places binary"


def _scored(model: Model, order: int, bits: int, schema: pa.Schema):
    """A block with its totals: sums of its texts without backoff weights, and the shares of its own n-grams in these weights."""

    def run(carried: pa.Table, answers: pa.Table) -> pa.Table:
        if carried.num_rows != 1 or not answers.num_rows:
            raise RuntimeError("the input changed between two reads; write it first")
        row, replies = carried.to_pylist()[0], answers.to_pylist()
        block = Block(unpacked_counts(row["codes"]), np.frombuffer(row["hashes"], np.uint64), unpacked_counts(row["bounds"]), np.asarray(row["held"], bool))
        n_docs, kind = len(row["ids"]), Kind(counts=True)
        log = probability = below = None  # of each token by the longest n-gram so far; of its last shorter n-gram; counts of these
        rows, asked_of, offset = [], [], 0
        for level, (keys, example, inverse, begin) in enumerate(block.levels(order), 1):
            (count,), owned = joined_answers(kind, [r for r in replies if r["level"] == level])
            if level == 1:
                texts = int(count[np.searchsorted(keys, _END >> np.uint64(64 - BITS))])  # as many texts begin as end
                probability, base = model.words(count)[inverse], model.base(count)[inverse]
                log, known = np.log10(probability), count[inverse] > 0
            else:
                kept = kept_counts(count, model.factors[level - 1])
                # histories: the n-grams one shorter that end before each token, and that before a text
                past = np.concatenate([[0], where[:-1]])
                past[block.first] = len(before)
                total = np.append(below, texts)[past]
                there = count[inverse] > 0
                own = owned & (count > 0)
                of = past[example[own]]
                freed = np.bincount(of, count[own] - kept[own], len(before) + 1)
                taken = np.bincount(of, probability[example[own]], len(before) + 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    probability = np.where(there, kept[inverse] / total, 0.0)
                    log = np.where(there, np.log10(probability), log)
                backed = np.flatnonzero(~there & (total > 0))
                asked = np.zeros(len(before) + 1, bool)
                asked[past[backed]] = True
                history = np.append(before, begin_before)
                some = np.flatnonzero(asked | (freed > 0))
                some = some[np.argsort(history[some])]
                for p, s, e in part_slices(history[some], bits):
                    c = some[s:e]
                    rows.append({"block": row["block"], "level": level, "part": p, "keys": packed_keys(history[c]), "values": packed_floats(np.concatenate([freed[c], taken[c]]))})
                place = np.zeros(len(history), np.int64)
                place[some] = offset + np.arange(len(some))
                # a seen n-gram of this length needs none of the weights that shorter ones took
                asked_of = [(t[~there[t]], w[~there[t]]) for t, w in asked_of] + [(backed, place[past[backed]])]
                offset += len(some)
                rows.append({"block": row["block"], "level": -level, "values": packed_floats(np.append(below, texts)[some].astype(np.float64))})
            where, before, below, begin_before = inverse, keys, count, begin
        total = lambda x: np.bincount(block.doc, x, n_docs)
        sums = np.stack([np.bincount(block.doc, minlength=n_docs), total(known), total(base), total(log)])
        token, place = (np.concatenate([np.empty(0, np.int64), *(a[k] for a in asked_of)]) for k in (0, 1))
        order_ = np.argsort(token, kind="stable")
        per_doc = np.bincount(block.doc[token], minlength=n_docs)
        rows.append({"block": row["block"], "level": 0, "ids": row["ids"], "held": row["held"], "sums": packed_floats(sums.ravel()), "docs": packed_counts(per_doc), "places": packed_counts(place[order_])})
        return pa.Table.from_pylist(rows, schema)

    return run


def _finished(order: int, id_type: pa.DataType):
    """A block's texts and the weights that they asked for: the scores."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows, replies, kind = own.to_pylist(), answers.to_pylist(), Kind(counts=False)
        texts = next(r for r in rows if r["level"] == 0)
        n_docs = len(texts["ids"])
        sums = unpacked_floats(texts["sums"]).reshape(4, n_docs)
        weights = [np.empty(0)]
        for level in range(2, order + 1):
            (freed, taken), _ = joined_answers(kind, [r for r in replies if r["level"] == level])
            total = unpacked_floats(next(r["values"] for r in rows if r["level"] == -level))
            with np.errstate(divide="ignore", invalid="ignore"):
                weights.append(np.log10(freed / total / np.maximum(1 - taken, 1e-12)))
        doc = np.repeat(np.arange(n_docs), unpacked_counts(texts["docs"]))
        score = sums[3] + np.bincount(doc, np.concatenate(weights)[unpacked_counts(texts["places"])], n_docs)
        columns = [pa.array(texts["ids"], id_type), pa.array(texts["held"], pa.bool_()), *(pa.array(sums[k].astype(np.int64)) for k in (0, 1)), pa.array(sums[2]), pa.array(score)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, held_out: str = "held_out", doc_id: str = "doc_id", text: str = "text", order: int = 2) -> tuple[DataFrame, Model]:
    """(scores of all texts, the model); counts come from those whose ``held_out`` is false."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl.format(id_type)))
    each = F.coalesce(F.octet_length("text"), F.lit(0)) + 6
    size, blocks = (x or 0 for x in own.agg(F.sum(each), F.sum(F.greatest(each, F.lit(128)) / BLOCK_BYTES + F.lit(2e-4))).first())
    bits = min(PART_BITS, max(3, (int(size) // 6 // PART_TOKENS).bit_length()))
    sent, kind = own.mapInArrow(_sent(order, bits), MESSAGE), Kind(counts=True)
    blocks = int(blocks) + 1  # about; a batch of 10,000 rows is a block at least
    tables = written(exchanged(sent, kind, blocks, bits, bits), "katz", partition_by=["level"])
    parts = tables.where("block is null").groupBy("level").agg(F.array(*(F.sum(F.get("seen", F.lit(i))) for i in range(LARGEST + 3))).alias("seen")).collect()
    seen = {r.level: list(r.seen) for r in parts}
    model = Model([seen.get(level, [0] * (LARGEST + 3)) for level in range(1, order + 1)])
    answers = tables.where("block is not null").select(*_MESSAGE.names)
    carried = own.mapInArrow(_carried(arrow(CARRIED)), CARRIED.format(id_type))
    scored = carried.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(model, order, bits, arrow(SCORED)), SCORED.format(id_type))
    scored = written(scored, "scored", partition_by=["level"])
    weights = exchanged(scored.where("level > 0").select(*_MESSAGE.names), Kind(counts=False), blocks, bits, bits)
    fields = arrow("doc_id {}")
    result = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    texts = scored.where("level <= 0")
    return texts.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(_finished(order, fields.field(0).type), result), model
