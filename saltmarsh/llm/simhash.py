"""SimHash near-duplicates: pigeonring candidate chains, exact Hamming check, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from saltmarsh.llm.common import BATCH_BYTES, ByRow, chosen, components, free_name, pieces, shared_dir, take, trim, with_fields, written
from saltmarsh.llm.shingles import POSTINGS, common, meeting, postings, shingles, shingles_of, tokens_of

#: Shingle hashes whose bits are counted at once. The words and their places are lists over the whole text: about 150
#: bytes a word, so a text of 100 MB takes some 3 GB.
BLOCK = 1 << 17
#: Words of 64 bits of a wide fingerprint, and least hashes by which texts are gathered.
WIDE, STARS = 4, 4
#: Shingles of the sets that are held at once where pairs are decided, in each of two parts.
LOAD = 1 << 21


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles (repeats count); 0 without a word."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = [x + i for i, x in enumerate(accumulate(map(len, tokens)))]
    starts = [0, *(x + 1 for x in ends)]
    ends = ends[words - 1 :] or ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        shingles = [joined[a:b] for a, b in zip(starts[at : min(n, at + BLOCK)], ends[at : at + BLOCK])]
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint's bits as a signed bigint."""
    return with_fingerprints(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "fp", words, seed, keep_text=False)


def with_fingerprints(docs: DataFrame, name: str, words: int = 3, seed: int = 42, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the fingerprint's bits as a signed bigint in column ``name``."""
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found)], [*(batch.schema.names[i] for i in kept), name])

    return docs.mapInArrow(run, with_fields(T.StructType([f for i, f in enumerate(docs.schema) if i in kept]), f"`{name}` bigint"))


def ring(segments: int = 5) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of the 64 bits, in ring order."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(parts: list[tuple[int, int]], chosen: tuple[int, ...]) -> int:
    return sum(((1 << w) - 1) << at for at, w in (parts[i % len(parts)] for i in chosen))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, hot: int = 64) -> DataFrame:
    """(a, b): pairs of different fingerprints within 2 bits that connect all that are within 2 bits.

    Pigeonring over five segments with a budget of 2: some segment starts a chain whose first l segments
    differ in at most l * 2/5 bits in sum, for every l. So the first two are equal, and the next two differ
    in at most one bit together: one of them is equal too. Fingerprints meet on three equal segments of
    such a chain (38 or 39 bits, ten keys each), the chain's budgets are checked, then all 64 bits.

    Where more than ``hot`` fingerprints share a key, pairs are not formed: each sends itself and itself
    with one of the other bits flipped, and those that send the same value (so within 2 bits) are linked to
    the least of them. Two that differ in at most two of these bits always send a common value, so no
    link is lost, and the work stays in proportion to the fingerprints.
    """
    spark, parts = fps.sparkSession, ring()
    kinds = [(i, j) for i in range(5) for j in (i + 2, i + 3)]
    masks = [_mask(parts, (i, i + 1, j)) for i, j in kinds]
    rows = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    keys = fps.select("fp", F.explode(F.array(*rows)).alias("x")).select("fp", "x.*")
    counts = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keys.join(counts, ["kind", "key"]), "simhash-keys")
    few = shared.where(F.col("n") <= hot).select("kind", "key", "fp")
    x = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for k, (i, _) in enumerate(kinds):
        third, fourth = (F.bit_count(x.bitwiseAND(F.lit(_signed(_mask(parts, (c,)))))) for c in (i + 2, i + 3))
        chain = F.when(F.col("kind") == k, (third <= 1) & (third + fourth <= 1)).otherwise(chain)
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["kind", "key"]).where("a < b")
    pairs = pairs.where(chain).where(F.bit_count(x) <= 2).select("a", "b")
    many = shared.where(F.col("n") > hot)
    flips = F.lit(None)
    for k, m in enumerate(masks):
        free = [_signed(1 << b) for b in range(64) if not m >> b & 1]
        flips = F.when(F.col("kind") == k, F.array(F.lit(0).cast("bigint"), *map(F.lit, free)).cast("array<bigint>")).otherwise(flips)
    sent = many.select("kind", "fp", F.explode(flips).alias("flip")).select("kind", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = sent.groupBy("kind", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = sent.join(least, ["kind", "value"]).where("a <> fp").selectExpr("a", "fp b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for every row of ``docs``.

    component_id is the smallest id among all documents reachable by links, itself included. A null text
    counts as empty (fingerprint 0); rows of null id keep their row, and take the smallest id that is
    not null of their component, or null if it has none. Repeated ids keep a row each. An empty
    table gives no rows. Columns other than the two named are not read.
    """
    shared_dir(docs.sparkSession)
    own = written(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    return own.join(classes(own), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(own: DataFrame) -> DataFrame:
    """(fp, component, component_id) of a written table (doc_id, fp): each fingerprint's component, named by its least
    fingerprint, and the component's least id."""
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = components(links(fps.select("fp")))
    named = fps.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def one_each(docs: DataFrame, words: int = 3, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: that of the least id (ids that are null come
    last; of equal ids any one). Columns stay as they are, whatever their names; an empty table gives no rows.

    Without ``similarity`` texts are linked by links(): fingerprints within 2 bits. With it, by similar(): those whose sets
    of word shingles have at least that Jaccard similarity. Texts of the same words are one, null and blank ones too.
    """
    shared_dir(docs.sparkSession)
    row = free_name("saltmarsh_row", docs.columns)
    if similarity is None:
        fp = free_name("saltmarsh_fp", docs.columns)
        own = written(with_fingerprints(docs, fp, words, text_col=text_col).withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
        narrow = own.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
        groups = narrow.join(classes(narrow.select("doc_id", "fp")).select("fp", "component"), "fp").groupBy("component")
        keep = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
        return chosen(own, row, keep, "simhash-keep").drop(row, fp)
    print_ = free_name("saltmarsh_print", docs.columns)
    own = written(_with_prints(docs, print_, words, text_col).withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    number, p = F.col(id_col).cast("bigint"), F.col(print_)
    first = F.min(F.struct(number.isNull().alias("no_id"), number.alias("doc_id"), F.col(row).alias("row"), p["prints"].alias("prints"), p["size"].alias("size"), p["least"].alias("least")))
    texts = written(own.groupBy(p["same"].alias("same")).agg(first.alias("first")).select("first.*"), "simhash-texts")
    narrow = own.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    groups = similar(narrow, texts, words, similarity).withColumnRenamed("id", "row")
    named = texts.select("no_id", "doc_id", "row").join(groups, "row", "left")
    keep = named.groupBy(F.coalesce("component", "row")).agg(F.min(F.struct("no_id", "doc_id", "row"))["row"].alias("row"))
    return chosen(own, row, keep, "simhash-keep").drop(row, print_)


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of 64-bit hashes in WIDE words of 64 bits; the further words are of mixed hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), BLOCK // WIDE):
        own = hashes[at : at + BLOCK // WIDE]
        mixed = np.empty((len(own), WIDE), np.uint64)
        for k in range(WIDE):
            x = own + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = x ^ x >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8").tolist()


PRINT = "same: binary, prints: array<bigint>, size: int, least: array<bigint>"


def _with_prints(docs: DataFrame, name: str, words: int, text_col: str) -> DataFrame:
    """``docs`` with a struct of PRINT: a hash of the text's words, the wide fingerprint of its set of shingles, the set's
    size, and the STARS least hashes."""
    at, names = docs.columns.index(text_col), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take(__name__)
        for batch in pieces(batches):
            same, prints, sizes, least = [], [], [], []
            for x in batch.column(at):
                tokens = tokens_of(x.as_py())
                own = shingles_of(tokens, words)
                same.append(hashlib.blake2b(b" ".join(tokens), digest_size=16).digest())
                prints.append(wide_fingerprint(own))
                sizes.append(len(own))
                least.append(own[:STARS].view(np.int64).tolist())
            longs = pa.list_(pa.int64())
            column = pa.StructArray.from_arrays([pa.array(same, pa.binary()), pa.array(prints, longs), pa.array(sizes, pa.int32()), pa.array(least, longs)], ["same", "prints", "size", "least"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names)

    return docs.mapInArrow(run, with_fields(docs.schema, f"`{name}` struct<{PRINT}>"))


def budgets(similarity: float) -> list[tuple[int, int]]:
    """(size, bits): sets of at least that size and similarity differ in more bits of their wide fingerprints with a chance
    of less than one in a billion, by 6.2 standard deviations. Of large sets a bit differs with the chance acos(c) / pi,
    where c, their cosine, is at least 2 s / (1 + s); of sets of some shingles with up to a quarter more (ties of the count)."""
    chance, bits, out = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE, []
    for size, more in ((0, 1.25), (32, 1.06)):
        p = min(0.5, chance * more)
        out.append((size, math.ceil(bits * p + 6.2 * math.sqrt(bits * p * (1 - p)))))
    return out


def _near(similarity: float) -> Column:
    """Pigeonring over the WIDE words of the fingerprints prints_a and prints_b as segments: if they differ in at most a
    budget of bits, some segment starts a chain whose first l segments differ in at most l / WIDE of it in sum, for every
    l. Chains are followed only as far as they stay within that; the whole ring is the full Hamming check."""
    words = [F.bit_count(F.col("prints_a")[k].bitwiseXOR(F.col("prints_b")[k])) for k in range(WIDE)]
    budget = F.lit(0)
    for size, bits in budgets(similarity):
        budget = F.when(F.least("size_a", "size_b") >= size, bits).otherwise(budget)
    some = F.lit(False)
    for start in range(WIDE):
        chain, total = F.lit(True), F.lit(0)
        for length in range(1, WIDE + 1):
            total = total + words[(start + length - 1) % WIDE]
            chain &= total * WIDE <= budget * length
        some |= chain
    return some


def similar(rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, component) of the rows of ``texts`` (a written table row, prints, size, least; a row for each different text)
    that are similar to another one: their sets of shingles have at least this Jaccard similarity, or a chain of such
    pairs connects them. ``rows`` (a written table row, text) has the texts.

    A fingerprint of 64 bits differs in 4 to 11 at 0.8, and no segment of so wide a budget tells texts apart. So those
    meet that share a rare shingle: any two such sets share one of the first n - ceil(similarity * n) + 1 of their n
    shingles in an order that all follow, rare ones first. Of the pairs that meet, pigeonring over WIDE * 64 bits drops
    those that differ too much (see budgets()), and the sets themselves decide.

    Large groups are gathered first: texts that share one of their STARS least hashes meet the least of its texts only,
    which is linear. What is connected then is one class, and the exact search that follows forms pairs between classes.
    """
    prints, sizes = texts.select("row", "prints", "size"), texts.select("row", "size")
    least = texts.select("row", F.explode("least").alias("h"))
    centre = least.groupBy("h").agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1").select("h", "a")
    stars = least.join(centre, "h").where("a <> row").selectExpr("a", "row b").distinct()
    one = written(_alike(rows, _pruned(stars, prints, similarity), sizes, words, similarity), "simhash-stars")
    groups = written(components(one), "simhash-classes").selectExpr("id row", "component")
    class_ = texts.select("row").join(groups, "row", "left").select("row", F.coalesce("component", "row").alias("value"))
    table = ByRow(class_, "simhash-class")
    often, counts = common(rows, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            number = b.column(0).to_numpy()
            hit, value = table.find(number)
            if hit.any():
                own = b.column(1).filter(pa.array(hit)).to_pylist()
                yield postings(number[hit], value[hit], own, words, similarity, often, counts)

    met = meeting(rows.select("row", "text").mapInArrow(run, POSTINGS), similarity)
    two = written(_alike(rows, _pruned(met, prints, similarity), sizes, words, similarity), "simhash-pairs")
    return components(one.select("a", "b").union(two.select("a", "b")))


def _pruned(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(prints.toDF(side, f"prints_{side}", f"size_{side}"), side)
    sizes = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    return written(pairs.where(sizes).where(_near(similarity)).select("a", "b"), "simhash-near")


LOADED = "component bigint, x bigint, y bigint, a bigint, b bigint, own binary"


def _alike(rows: DataFrame, pairs: DataFrame, sizes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): pairs whose sets reach the similarity and that connect all that the given ones (a written table) connect;
    ``sizes`` (row, size) has the sizes of the sets. Only texts of pairs are read again.

    A set is sent once to where the pairs of its component are, not once a pair. The sets of a component of more than LOAD
    shingles are divided into parts, and those of each two parts meet."""
    joined = written(components(pairs), "simhash-candidates").withColumnRenamed("id", "row")
    table = ByRow(joined.selectExpr("row", "component value"), "simhash-wanted")
    weight = joined.join(sizes, "row").groupBy("component").agg(F.sum("size").alias("size")).where(F.col("size") > LOAD)
    wide = sorted((r.component, -(-r.size // LOAD)) for r in weight.collect())  # one for each LOAD shingles at most
    large, parts = np.array([x for x, _ in wide], np.int64), np.array([x for _, x in wide], np.int64)

    def divided(component: np.ndarray) -> np.ndarray:
        out = np.ones(len(component), np.int64)
        if len(large):
            at = np.minimum(np.searchsorted(large, component), len(large) - 1)
            out = np.where(large[at] == component, parts[at], 1)
        return out

    def part(row: int, count: int) -> int:
        return xxh64_intdigest(row.to_bytes(8, "little", signed=True)) % count

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            number = b.column(0).to_numpy()
            hit, component = table.find(number)
            texts = b.column(1).filter(pa.array(hit))
            out, size = [], 0
            for row, c, count, text in zip(number[hit].tolist(), component[hit].tolist(), divided(component[hit]).tolist(), texts):
                own, mine = shingles(text.as_py(), words).tobytes(), part(row, count)
                for other in range(count):
                    out.append((c, min(mine, other), max(mine, other), row, None, own))
                    size += len(own)
                    if size > BATCH_BYTES:
                        yield _loaded(out)
                        out, size = [], 0
            yield _loaded(out)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (batch.column(i).to_numpy() for i in range(3))
            counts = divided(c)
            x, y = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            for i in np.flatnonzero(counts > 1).tolist():
                x[i], y[i] = sorted((part(int(a[i]), int(counts[i])), part(int(b[i]), int(counts[i]))))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (c, x, y, a, b)), pa.nulls(len(a), pa.binary())], LOADED_NAMES)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, root = None, {}, {}

        def top(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = i = root.get(up, up)
            return i

        for batch in batches:
            good: list[tuple[int, int]] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for i, (c, x, y, a, b) in enumerate(keys):
                if place != (c, x, y):
                    place, held, root = (c, x, y), {}, {}
                if b is None:
                    held[a] = np.frombuffer(batch.column(5)[i].as_py(), np.uint64)
                elif (p := top(a)) != (q := top(b)):  # else others connect them
                    one, two = held[a], held[b]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                        root[max(p, q)] = min(p, q)
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["a", "b"])
        trim()

    own = rows.select("row", "text").mapInArrow(sets, LOADED)
    asked = pairs.join(joined.toDF("a", "component"), "a").select("a", "b", "component").mapInArrow(places, LOADED)
    blocks = own.union(asked).repartition("component", "x", "y")
    return blocks.sortWithinPartitions("component", "x", "y", F.col("b").asc_nulls_first()).mapInArrow(tried, "a bigint, b bigint")


LOADED_NAMES = [x.split()[0] for x in LOADED.split(", ")]


def _loaded(out: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], LOADED_NAMES)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
