"""Quality rules: base measures of a text, and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one
of trusted texts, one of all texts. A document's verdict is the mean log ratio
of its n-grams, in whole millionths, so it does not depend on the order in
which anything is summed.

Texts fall into ``folds`` by a hash of their words' characters alone. A text is
judged by a model that leaves out the trusted texts of its own fold, whether it
is trusted itself or not: so no text is judged by what it taught, equal texts
are judged alike, and a label never changes the verdict on its own text.

With ``group`` (a column, such as the language) each group has models of its
own, so a group's share of the trusted texts doesn't weigh on its ratios; the
``max_groups`` groups with the most trusted documents do, all others with any
share one. Trusted counts are smoothed towards the raw ones, so few trusted
texts don't weigh on the ratios either. With ``loss`` a group's cut is the ratio
below which that share of its trusted documents at most falls; else ``threshold`` is.

All passes are DataFrame expressions; the driver only sees the groups and their
cuts. Broadcast are the ratios (at most ``max_groups`` + 1 groups x ``folds`` x
``buckets`` numbers: 9 MB) and up to ``BROADCAST_IDS`` trusted ids; more of them
are shuffled to the rows that a sieve of fixed size (8 MB) lets through. Counts
of the raw corpus cover every document, and models and cuts every trusted one.

Defined results: a null text has no words and fails; ids are compared as text,
and a null id is never trusted; repeated rows count each; a null group is the
group ""; in a group without any trusted document, and in a fold where none is
left, the ratio is 0, and where no cut can be taken only the base rules decide;
other columns are kept, and columns of the input with the names that are added
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ADDED = (*MEASURES, "ratio", "kept")
WINDOW = 8
BROADCAST_IDS = 200_000
SLOTS = 1 << 26  # bits of the sieve
CHUNK = 1024  # words of 64 bits in a row of it


def words(text: Column) -> Column:
    """The words of a text. Spaces are made one character first, for splitting by one character needs no regex."""
    text = F.coalesce(text, F.lit(""))
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _pairs(df: DataFrame, hashes: str, gap: int, name: str, when: Column | None = None) -> DataFrame:
    """Add ``name``: hashes of elements i and i + gap. A column of its own, so that Spark computes it once.

    The hash of a run is the exclusive or of its words' hashes, each shifted by
    its distance from the end: no mixing is needed above that of the words.
    """
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    pairs = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.shiftleft(a, gap).bitwiseXOR(b))
    return df.withColumn(name, pairs if when is None else F.when(when, pairs))


def _with_hashes(df: DataFrame, text: str) -> DataFrame:
    """Add _words, _h1 (hash of each word) and _h2 (of each two words)."""
    df = df.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    return _pairs(df, "_h1", 1, "_h2")


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Add the base measures to a frame of _with_hashes.

    Eight-word windows are compared by 64-bit hashes built by doubling (two,
    four, eight words). A repeated window repeats five runs of four words, so
    only texts with so many build and sort the hashes of their windows.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(full, "\n")
    lines = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = _pairs(df, "_h2", 2, "_h4").withColumn("_lines", lines)
    df = df.withColumn("_some", F.size("_h4") - F.size(F.array_distinct("_h4")) >= WINDOW - 3)
    df = _pairs(df, "_h4", 4, "_h8", F.col("_some"))
    order = F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_order", F.when(F.col("_some"), order))
    at = lambda i: F.get("_order", i)["h"]
    twice = F.filter("_order", lambda x, i: (x["h"] == at(i - 1)) | (x["h"] == at(i + 1)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    df = df.withColumn("_starts", F.when(F.col("_some"), starts))
    # words under the windows: each adds the words that the window before it doesn't reach
    reach = F.transform("_starts", lambda s, i: F.least(F.lit(WINDOW), s - F.coalesce(F.get("_starts", i - 1), F.lit(-WINDOW))))
    n_repeat = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(full, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.when(F.col("_some"), n_repeat), F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def _bucket(hashed: Column, buckets: int) -> Column:
    """``buckets`` is a power of two."""
    return hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _place(key: Column) -> tuple[Column, Column, Column]:
    """Where a key's hash falls in the sieve: its row, the word in that row and the bit in that word."""
    slot = F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1))
    word = F.shiftright(slot, 6)
    return F.floor(word / CHUNK).cast("int"), F.pmod(word, F.lit(CHUNK)).cast("int"), F.pmod(slot, F.lit(64)).cast("int")


def sieve(ids: DataFrame) -> DataFrame:
    """(_chunk, _bits): ``SLOTS`` bits, set where the hash of an id falls, in rows of ``CHUNK`` words of 64 bits."""
    chunk, word, bit = _place(F.col("_id"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    number = F.col("id")
    zeros = ids.sparkSession.range(SLOTS // 64).select(F.floor(number / CHUNK).cast("int").alias("_chunk"), F.pmod(number, F.lit(CHUNK)).cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    bits = ids.select(chunk.alias("_chunk"), word.alias("w"), one.alias("bits")).unionByName(zeros).groupBy("_chunk", "w").agg(F.bit_or("bits").alias("bits"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"])
    return bits.groupBy("_chunk").agg(words.alias("_bits"))


class Trust:
    """All trusted ids, and how rows meet them.

    Up to ``BROADCAST_IDS`` ids are broadcast. More are joined by a shuffle, and
    so that not all texts move for it, only with the rows that pass the sieve:
    every row of a trusted id and few others, which the join tells apart.
    """

    def __init__(self, trusted_ids: DataFrame):
        ids = trusted_ids.select(F.col(trusted_ids.columns[0]).cast("string").alias("_id")).where("_id is not null").distinct()
        self.ids = written(ids.withColumn("_trusted", F.lit(True)), "trusted")
        self.few = self.ids.count() <= BROADCAST_IDS
        self.sieve = None if self.few else written(sieve(self.ids), "sieve")

    def _sieved(self, df: DataFrame, through: bool) -> DataFrame:
        """The rows that pass the sieve, or those that don't; a null id never does."""
        chunk, word, bit = _place(F.col("_id"))
        df = df.withColumn("_chunk", chunk).join(F.broadcast(self.sieve), "_chunk")
        passes = F.col("_id").isNotNull() & (F.getbit(F.get("_bits", word), bit) == 1)
        return df.where(passes if through else ~passes).drop("_chunk", "_bits")

    def only(self, df: DataFrame) -> DataFrame:
        """The rows of trusted ids."""
        if self.few:
            return df.join(F.broadcast(self.ids), "_id")
        return self._sieved(df, True).join(self.ids.hint("shuffle_hash"), "_id")

    def marked(self, df: DataFrame) -> DataFrame:
        """All rows, with _trusted: true or null."""
        if self.few:
            return df.join(F.broadcast(self.ids), "_id", "left")
        found = self._sieved(df, True).join(self.ids.hint("shuffle_hash"), "_id", "left")
        return found.unionByName(self._sieved(df, False).withColumn("_trusted", F.lit(None).cast("boolean")))


REST = "\0rest"


def groups_with_models(own: DataFrame, trust: Trust, max_groups: int) -> list[str]:
    """The groups with the most trusted documents, by name, and ``REST`` where there are more."""
    trusted = trust.only(own.select("_id", "_group"))
    found = [r["_group"] for r in trusted.groupBy("_group").count().orderBy(F.desc("count"), "_group").limit(max_groups + 1).collect()]
    return sorted(found[:max_groups]) + [REST] * (len(found) > max_groups)


class Models:
    """The models of all groups and folds: a row for each, with the ratios of all buckets."""

    def __init__(self, groups: list[str], buckets: int, prior: float, folds: int):
        self.groups, self.buckets, self.prior, self.folds = groups, buckets, prior, folds
        self.tables: DataFrame | None = None

    def placed(self, df: DataFrame, text: str) -> DataFrame:
        """Add _g, the number of a row's group (null where it has no model), and _fold."""
        rest = F.lit(len(self.groups)) if REST in self.groups else F.lit(0)
        at = F.array_position(F.array(*map(F.lit, self.groups)), F.col("_group")) if self.groups else F.lit(0)
        number = F.when(at == 0, rest).otherwise(at).cast("int") - 1
        df = df.withColumn("_g", F.when(number >= 0, number))
        return df.withColumn("_fold", F.pmod(F.xxhash64(text), F.lit(self.folds)).cast("int"))

    def learn(self, own: DataFrame, trust: Trust) -> None:
        """Count the buckets of every group that has models, over all of its documents, and take the ratios.

        A ratio is in millionths of ln(p_trusted / p_raw). ``prior`` counts a
        bucket smooth the raw counts; as many in all pull the trusted ones
        towards p_raw, so few trusted texts give ratios near 0, and never lower
        ones for frequent n-grams than for those they lack.
        """
        rows = self.placed(own, "_text").where("_g is not null")
        rows = trust.marked(rows).withColumn("_fold", F.when(F.col("_trusted"), F.col("_fold")))
        grams = _with_hashes(rows, "_text").select("_g", "_fold", F.explode(F.concat("_h1", "_h2")).alias("_h"))
        names = [f"t{f}" for f in range(self.folds)]
        in_fold = [F.count(F.when(F.col("_fold") == f, 1)).alias(t) for f, t in enumerate(names)]
        counted = grams.groupBy("_g", _bucket(F.col("_h"), self.buckets).alias("b")).agg(F.count("*").alias("n"), *in_fold)
        groups = own.sparkSession.range(len(self.groups)).select(F.col("id").cast("int").alias("_g"))
        zeros = groups.select("_g", F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("b"), *(F.lit(0).cast("long").alias(c) for c in ("n", *names)))
        sums = lambda by: by.agg(*(F.sum(c).alias(c) for c in ("n", *names)))
        counts = written(sums(counted.unionByName(zeros).groupBy("_g", "b")), "counts")
        whole = sums(counts.groupBy("_g")).select("_g", *(F.col(c).alias(f"all_{c}") for c in ("n", *names)))
        mass = self.prior * self.buckets
        p = (F.col("n") + self.prior) / (F.col("all_n") + mass)

        def ratio(out: int) -> Column:
            rest, total = (sum((F.col(f"{a}{t}") for f, t in enumerate(names) if f != out), F.lit(0)) for a in ("", "all_"))
            return F.round(1e6 * F.log((rest / p + mass) / (total + mass))).cast("int")

        each = F.array(*(F.struct(F.lit(f).alias("_fold"), ratio(f).alias("ratio")) for f in range(self.folds)))
        ratios = counts.join(F.broadcast(whole), "_g").select("_g", "b", F.explode(each).alias("x")).select("_g", "b", "x._fold", "x.ratio")
        table = F.transform(F.sort_array(F.collect_list(F.struct("b", "ratio"))), lambda x: x["ratio"])
        self.tables = written(ratios.groupBy("_g", "_fold").agg(table.alias("_table")), "ratios")

    def judged(self, df: DataFrame) -> DataFrame:
        """Add ratio to placed rows with hashes. The broadcast holds groups x folds x buckets numbers of four bytes."""
        df = df.withColumn("_grams", F.concat("_h1", "_h2")).join(F.broadcast(self.tables), ["_g", "_fold"], "left")
        total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, h: a + F.get("_table", _bucket(h, self.buckets)))
        mean = F.floor(total / F.size("_grams")).cast("long")
        return df.withColumn("ratio", F.when((F.size("_grams") > 0) & F.col("_table").isNotNull(), mean).otherwise(F.lit(0).cast("long")))


def cuts(own: DataFrame, trust: Trust, models: Models, loss: float) -> list[int | None]:
    """The cut of each group: of its trusted documents of 20 words and more, ``loss`` at most have a smaller ratio."""
    df = models.judged(_with_hashes(models.placed(trust.only(own), "_text"), "_text"))
    # a filter would be copied, with the whole chain of columns behind it, below them; the percentile passes over nulls
    # and holds a count for each distinct ratio, which are whole millionths
    df = df.withColumn("_of", F.when(F.size("_words") >= 20, F.col("ratio")))
    found = df.groupBy("_g").agg(F.expr(f"percentile_disc({loss}) WITHIN GROUP (ORDER BY _of)").cast("long").alias("cut")).collect()
    by_group = {r["_g"]: r.cut for r in found}
    return [by_group.get(g) for g in range(len(models.groups))]


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = 16384,
    prior: float = 1.0,
    threshold: float = -0.06,
    group: str | None = None,
    loss: float | None = None,
    folds: int = 4,
    max_groups: int = 32,
) -> DataFrame:
    """``docs`` with the base measures, ratio (long, millionths of a nat per n-gram) and kept.

    ``trusted_ids``: its first column holds the ids of the trusted documents.
    """
    trust = Trust(trusted_ids)
    plain = [c for c in docs.columns if c.lower() not in ADDED]
    named = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    key = (F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"), named.alias("_group"))
    own = docs.select(*key)
    models = Models(groups_with_models(own, trust, max_groups), buckets, prior, folds)
    models.learn(own, trust)
    cut = F.lit(round(threshold * 1e6))
    if loss is not None:
        cut = F.get(F.array(*(F.lit(c).cast("long") for c in cuts(own, trust, models, loss) or [None])), F.col("_g"))
    # the row travels as one column, so no name in it meets those that are made here
    rows = docs.select(F.struct(*plain).alias("_row"), *key)
    df = models.judged(_measured(_with_hashes(models.placed(rows, "_text"), "_text"), "_text"))
    # a condition on kept would else be copied, with the whole chain of columns behind it, below them
    unmoved = F.monotonically_increasing_id() >= 0
    kept = ~F.col("base_failed") & F.coalesce(F.col("ratio") >= cut, F.lit(True)) & unmoved
    return df.select(*(F.col("_row")[c].alias(c) for c in plain), *MEASURES, "ratio", kept.alias("kept"))
