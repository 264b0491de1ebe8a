"""Near-duplicate documents by MinHash bands, signature checks, full sets and components.

1. ``describe``: one pass over the texts gives each document the size and a fingerprint of its
   shingle set, a signature of universal-hash minima and its band keys.
2. Documents with equal sets are one text, a node of the graph, so exact copies cost nothing further.
3. Band keys shared by several representatives form buckets.  Every document is paired once, with
   the smallest document that any of its buckets holds: linear, however large the buckets are.
4. Pairs whose signatures are too far apart are dropped, the others are confirmed on full sets.
5. Confirmed links are joined to components (alternating large-star and small-star).
   The smallest id of its members names a component; an id that several texts repeat joins theirs.
6. A bucket whose members lie in several components may still hide a link between them; links
   inside a component cannot change it and are skipped.  Members of such buckets are paired with
   the bucket's smallest and largest member where the components differ.  Buckets that are still
   open are compared in full, in blocks, across components, by their signatures.  What remains is
   confirmed as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctriage.llm.components import components
from doctriage.session import discard, stage

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MEMO_WORDS = 500_000
OUT_ROWS = 2000
BLOCK_MEMBERS = 1024
SMALL_BUCKET = 3  # members, all of whose pairs contain the smallest or the largest


@dataclass(frozen=True)
class Likeness:
    """What counts as near: word shingles of ``words`` with 100 * common >= ``percent`` * all.

    With 26 bands of 5 minima a pair of similarity 0.8 shares no band with probability 3e-5.
    Signatures agree in 130 places with a standard deviation of 0.035 at 0.8, so ``slack`` is
    more than four of those; pairs that pass are confirmed on full sets anyway.
    """

    words: int = 5
    percent: int = 80
    bands: int = 26
    rows: int = 5
    slack: float = 0.15
    seed: int = 11

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        factors = random.integers(0, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2)
        return factors + np.uint64(1), random.integers(0, 1 << 63, self.size, dtype=np.uint64)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * MIX_A
    values = (values ^ (values >> np.uint64(27))) * MIX_B
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def shingle_set(text: bytes, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; words are runs of bytes other than blanks and
    controls 9 to 13, with A-Z lower-cased.  Fewer words than ``width`` are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(count, np.uint64(width) * MIX_A, np.uint64)
        for at in range(width):
            factor = _mix(np.array([at + 1], np.uint64))[0] | np.uint64(1)
            total += hashes[at : at + count] * factor
        return np.unique(_mix(total))


def _minima(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        values = shingles[at : at + 512, None] * factors
        values += shifts
        np.minimum(best, values.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The narrow columns of each row, then its text."""
    *narrow, texts = batch.columns
    return zip(*(c.to_pylist() for c in narrow), (t or b"" for t in texts.cast(pa.large_binary()).to_pylist()))


def _versions(docs: DataFrame) -> DataFrame:
    """``id, version, text``: a hash of the text tells versions of one id apart."""
    return docs.select("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("version"), "text")


DESCRIBED = "id long, version long, n_shingles long, fingerprint binary, signature binary, bands array<long>"


def describe(docs: DataFrame, like: Likeness) -> DataFrame:
    """``id, version, n_shingles, fingerprint, signature, bands`` of whole texts (``id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo, (factors, shifts) = WordHashes(), like.coefficients()
        places = _mix(np.arange(1, like.size + 1, dtype=np.uint64)).reshape(like.bands, like.rows)
        rows: list[tuple] = []

        def frame() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([r[0] for r in rows], pa.int64()),
                    "version": pa.array([r[1] for r in rows], pa.int64()),
                    "n_shingles": pa.array([r[2] for r in rows], pa.int64()),
                    "fingerprint": pa.array([r[3] for r in rows], pa.binary()),
                    "signature": pa.array([r[4] for r in rows], pa.binary()),
                    "bands": pa.array([r[5] for r in rows], pa.list_(pa.int64())),
                }
            )
            rows.clear()
            return made

        for batch in batches:
            for name, version, text in _texts(batch):
                shingles = shingle_set(text, like.words, memo)
                if len(shingles):
                    with np.errstate(over="ignore"):
                        minima = _minima(shingles, factors, shifts)
                        keyed = (minima.reshape(like.bands, like.rows) + np.uint64(1)) * places
                        bands = _mix(keyed.sum(axis=1, dtype=np.uint64)).view(np.int64)
                    print_ = xxhash.xxh3_128_digest(shingles.tobytes())
                    rows.append((name, version, len(shingles), print_, minima.tobytes(), bands))
                else:
                    rows.append((name, version, 0, None, None, []))
                if len(rows) >= OUT_ROWS:
                    yield frame()
        if rows:
            yield frame()

    return _versions(docs).mapInArrow(run, DESCRIBED)


def _close_signatures(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose signatures agree in nearly as many places as the similarity demands."""
    signatures = texts.select("node", "signature")
    least = like.percent / 100 - like.slack
    both = pairs.join(signatures.toDF("a", "own"), "a").join(signatures.toDF("b", "other"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, other = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, like.size)
                    for i in (2, 3)
                )
                keep = pa.array((own == other).mean(axis=1) >= least)
                yield batch.select([0, 1]).filter(keep)

    return both.select("a", "b", "own", "other").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, needed: DataFrame, single: bool, like: Likeness) -> DataFrame:
    """``node, shingles`` of the texts in ``needed`` (``node, id, version``), written once.

    Unless every id and version is ``single``, only one of the rows that repeat them is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for name, text in _texts(batch):
                packed = shingle_set(text, like.words, memo).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"node": pa.array([name], pa.int64()), "shingles": pa.array([packed], pa.binary())}
                )

    named = _versions(docs).join(needed, ["id", "version"]).select("node", "text")
    if not single:
        named = named.groupBy("node").agg(F.first("text").alias("text"))  # all of them are equal
    return stage(named.mapInArrow(run, "node long, shingles binary"), "shingles")


def _alike(own: np.ndarray, others: list[np.ndarray], like: Likeness) -> np.ndarray:
    """Which of the ``others`` are similar enough to ``own``; all are sorted sets, none is empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    common = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
    return 100 * common >= like.percent * (len(own) + sizes - common)


def _confirmed(pairs: DataFrame, full: DataFrame, like: Likeness) -> DataFrame:
    """Pairs similar enough on their full shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(i).to_pylist() for i in (2, 3))
            keep = [
                bool(_alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], like)[0])
                for x, y in zip(*sides)
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(full.toDF("a", "own"), "a").join(full.toDF("b", "other"), "b")
    return stage(
        both.select("a", "b", "own", "other").mapInArrow(compare, "a long, b long").distinct(), "links"
    )


def _pairs(linked: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of ``id`` and ``end``."""
    ordered = linked.filter("id <> end").select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b"))
    return ordered.distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, component, size, low, high`` of the members of buckets over several components."""
    named = members.withColumnRenamed("id", "node").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return named.join(mixed.filter("x < y").select("key"), "key")


def _to_ends(members: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of close signatures of a document outside an end's component with that end of its
    bucket."""
    ends = F.explode(
        F.array(*[F.struct(F.col(c).alias("end"), F.col(f"{c}_in").alias("end_in")) for c in ("low", "high")])
    )
    owner = F.max(F.when(F.col("node") == F.col("low"), F.col("component"))).alias("low_in")
    other = F.max(F.when(F.col("node") == F.col("high"), F.col("component"))).alias("high_in")
    owners = members.groupBy("key").agg(owner, other)
    linked = members.join(owners, "key").select(F.col("node").alias("id"), "component", ends.alias("at"))
    across = linked.filter("component <> at.end_in").select("id", "at.end")
    return _close_signatures(_pairs(across), texts, like)


def _across(members: DataFrame, texts: DataFrame, full: DataFrame, like: Likeness) -> DataFrame:
    """Links between different components of one bucket, one for each two that are linked.

    Buckets are cut into blocks of about ``BLOCK_MEMBERS``; each pair of blocks is a group of its
    own, so a bucket of any size is spread over many tasks.  Pairs of close signatures are compared
    there on their full sets, so what leaves a group does not grow with its pairs.
    """
    known = members.filter(F.col("size") > SMALL_BUCKET)
    parts = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = (
        known.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", other)
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .select("key", "i", "j", "node", "component")
    )
    tiles = spread.join(full, "node").join(texts.select("node", "signature"), "node")
    least = (like.percent / 100 - like.slack) * like.size

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        nodes, owners = tile["node"].to_numpy(), tile["component"].to_numpy()
        prints = np.frombuffer(b"".join(tile["signature"]), np.uint32).reshape(-1, like.size)
        sets = [np.frombuffer(s, np.uint64) for s in tile["shingles"]]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for x in range(len(nodes)):
            apart = np.flatnonzero((owners != owners[x]) & (nodes > nodes[x]))
            close = apart[(prints[apart] == prints[x]).sum(axis=1) >= least]
            if len(close):
                for y in close[_alike(sets[x], [sets[y] for y in close], like)]:
                    ends = min(owners[x], owners[y]), max(owners[x], owners[y])
                    found.setdefault(ends, (nodes[x], nodes[y]))
        return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype="int64")

    return stage(tiles.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct(), "links")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links``; both tables are discarded."""
    known = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
    again = components(links.unionByName(known))
    discard(labels, links)
    return again


def text_classes(docs: DataFrame, described: DataFrame, like: Likeness) -> DataFrame:
    """``fingerprint, id, version, component`` of every text that has words, staged.

    Rows with equal shingle sets are one text; ``id`` and ``version`` are the smallest of them.
    ``component`` is the smallest (id, version) of the texts reachable by links, as a struct.
    """
    own = described.filter("id IS NOT NULL AND n_shingles > 0")
    first = F.min(F.struct("id", "version")).alias("first")
    same = [F.first(name).alias(name) for name in ("signature", "bands")]
    grouped = own.groupBy("fingerprint").agg(first, *same, F.count("*").alias("rows"))
    # Texts are numbered once they are written, so their numbers stay.
    numbered = grouped.select("fingerprint", "first.*", "signature", "bands", "rows")
    texts = stage(numbered.withColumn("node", F.monotonically_increasing_id()), "texts")
    exploded = texts.select(F.explode("bands").alias("key"), F.col("node").alias("id")).distinct()
    buckets = (
        exploded.groupBy("key")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"))
        .filter("size > 1")
    )
    bands = texts.select(F.explode("bands").alias("key"), F.col("node").alias("id"))
    members = stage(bands.join(buckets, "key"), "members")
    # One link per document first: to the smallest document that any of its buckets holds.
    lowest = members.groupBy("id").agg(F.min("low").alias("end"))
    tested = stage(_close_signatures(_pairs(lowest), texts, like), "close")
    single = own.groupBy("id", "version").count().filter("count > 1").isEmpty()
    needed = texts.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    full = _sets(docs, needed.select("node", "id", "version"), single, like)
    links = _confirmed(tested, full, like)
    labels = components(links)
    # What is left are buckets over several components: first their two ends, then all across.
    half = stage(_open(members, labels), "open")
    ends = stage(_to_ends(half, texts, like).join(tested, ["a", "b"], "left_anti"), "close")
    labels = _joined(labels, _confirmed(ends, full, like))
    rest = stage(_open(members, labels), "open")
    labels = _joined(labels, _across(rest, texts, full, like))
    discard(members, full, tested, links, half, ends, rest)
    named = texts.select("fingerprint", "id", "version", "node").join(labels, "node", "left")
    named = stage(named.select("fingerprint", "id", "version", F.coalesce("component", "node").alias("class")), "classes")
    least = named.groupBy("class").agg(F.min(F.struct("id", "version")).alias("component"))
    out = stage(named.join(least, "class").drop("class"), "text-classes")
    discard(texts, labels, named)
    return out


def _names(described: DataFrame, texts: DataFrame) -> DataFrame:
    """``of, component``: every id that has words and the smallest id it reaches, where an id that
    repeats with several texts joins their components."""
    own = described.filter("id IS NOT NULL AND n_shingles > 0").select("id", "fingerprint").distinct()
    named = own.join(texts.select("fingerprint", F.col("component.id").alias("name")), "fingerprint")
    named = stage(named.select("id", "name").distinct(), "named")
    several = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    bridges = stage(named.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("name").alias("b")), "bridges")
    if not bridges.isEmpty():
        joined = components(bridges).select(F.col("node").alias("name"), "component")
        named = named.join(joined, "name", "left").select("id", F.coalesce("component", "name").alias("name")).distinct()
    return named.select(F.col("id").alias("of"), F.col("name").alias("component"))


def near_duplicates(documents: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents``.

    ``kept`` marks the smallest id of each component.  Null, blank and empty texts have an empty
    set and are linked with nothing.  Rows without an id are linked with nothing, have a null
    component and are kept.  Rows that repeat an id are versions of one document: they share a
    component whatever their texts, and what is near to any of them is reachable from all.  An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    described = stage(describe(docs, like), "described")
    names = _names(described, text_classes(docs, described, like))
    found = described.select("id", "n_shingles").join(names, F.col("id") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(documents: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``documents`` without the near copies, in all their columns: of the texts that links join, one
    row with the smallest id stays, of several such texts the one of least hash.

    Texts count here, not ids: an id that repeats with unlike texts may stay once for each.  Rows
    that repeat id and text stay once, by the least hash over all columns.  Rows without words stay
    once for each id, rows without an id always.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    described = stage(describe(docs, like), "described")
    texts = text_classes(docs, described, like)
    rows = described.filter("id IS NOT NULL")
    near = rows.join(texts.select("fingerprint", "component"), "fingerprint")
    copies = near.filter(F.col("component") != F.struct("id", "version")).select("id", "version")
    version = F.coalesce(F.xxhash64("text"), F.lit(0))
    gone = copies.select(F.col("id").alias("_gone"), F.col("version").alias("_version")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("_gone")) & (version == F.col("_version"))
    kept = documents.join(gone, same, "left_anti")
    if rows.groupBy("id", "version").count().filter("count > 1").isEmpty():
        return kept
    row = F.struct("*")
    named = kept.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), version.alias("_version"), row.alias("_row"))
    one = F.min_by("_row", F.xxhash64("_row")).alias("_row")
    return named.groupBy("_id", "_version").agg(one).select("_row.*").unionByName(kept.filter("doc_id IS NULL"))
