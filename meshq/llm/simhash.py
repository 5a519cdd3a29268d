"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of three differing bits or fewer, at least two segments hold
at most one each. The perfect Golay code (23, 12) decodes a segment to the index of the only codeword within three bits; all
codewords within four bits (one to six) then hold the nearest codeword of any segment one bit away. So a fingerprint is filed
under three keys, the nearest indices of each two segments, and sought under all pairs of its near indices: every link is
found, and none needs a bucket's pairs. Candidates are verified by their differing bits inside the join. Equal
fingerprints are one node, so that groups of copies don't multiply.

Null text counts as empty: no words, fingerprint zero, linked like any other. Ties don't arise, for every link is kept; repeated
rows share their fingerprint and component. Rows with a null id are returned with the component of their fingerprint's
least id. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshq.llm.common import all_columns, drop, fresh, materialize, release
from meshq.llm.components import components

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = tuple(combinations(range(len(SEGMENTS)), 2))
#: Generator polynomial of the code.
GENERATOR = 0b110001110101


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of each run of n words, joined by blanks; fewer words: of the whole sequence."""
    w = text.lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(w))
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: list[int], block: int = 1 << 16) -> int:
    """A bit is set if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, block):
        counts += np.unpackbits(h[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [majority(shingle_hashes((x.as_py() or "").encode("utf-8", "surrogatepass"), shingle)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    return documents.select(id_col, text).mapInArrow(run, f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, fp long")


class Golay:
    """Tables of the code, made from its generator: remainders, least errors, and other codewords four bits away."""

    def __init__(self) -> None:
        self.rest = np.array([self._mod(i << 11) for i in range(1 << 12)], np.int32)
        words = (np.arange(1 << 12, dtype=np.int64) << 11) | self.rest
        self.words = words
        self.error = np.zeros(1 << 11, np.int32)
        for n in range(1, 4):
            for bits in combinations(range(23), n):
                e = sum(1 << b for b in bits)
                self.error[self.syndrome(np.array([e]))[0]] = e
        light = words[np.bitwise_count(words) == 7]
        self.others = np.zeros((1 << 11, 5), np.int32)
        self.n_others = np.zeros(1 << 11, np.int32)
        for s in np.flatnonzero(np.bitwise_count(self.error) == 3):
            got = light[(light & self.error[s]) == self.error[s]]
            self.others[s, : len(got)] = got >> 11
            self.n_others[s] = len(got)

    @staticmethod
    def _mod(x: int) -> int:
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.rest[x >> 11] ^ (x & 0x7FF).astype(np.int32)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and the syndrome."""
        s = self.syndrome(x)
        return (x ^ self.error[s]) >> 11, s

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all codewords within four bits: (n, 6), and which of them hold."""
        i, s = self.nearest(x)
        return np.concatenate([i[:, None], i[:, None] ^ self.others[s]], axis=1), np.arange(6)[None, :] <= self.n_others[s][:, None]


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    _golay = _golay or Golay()
    return _golay


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def filed_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 3): the keys under which a fingerprint is filed."""
    i = [golay().nearest(s)[0] for s in segments(fp)]
    return np.stack([(p << 24) | (i[a] << 12) | i[b] for p, (a, b) in enumerate(PAIRS)], axis=1)


def sought_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys under which a fingerprint is sought."""
    near = [golay().near(s) for s in segments(fp)]
    rows, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        holds = near[a][1][:, :, None] & near[b][1][:, None, :]
        k = (p << 24) | (near[a][0][:, :, None] << 12) | near[b][0][:, None, :]
        r = np.nonzero(holds)
        rows.append(r[0])
        keys.append(k[r])
    return np.concatenate(rows), np.concatenate(keys)


def keys_of(fps: DataFrame, sought: bool) -> DataFrame:
    """fps (fp): fp and key, a row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            u = fp.view(np.uint64)
            if sought:
                rows, keys = sought_keys(u)
            else:
                keys = filed_keys(u)
                rows, keys = np.repeat(np.arange(len(u)), keys.shape[1]), keys.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(keys.astype(np.int32))], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key int")


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """fps (fp, distinct): a and b, the pairs that differ in at most that many bits (3 at most)."""
    if not 0 <= most <= 3:
        raise ValueError("three segments find links of 3 bits or fewer")
    filed = keys_of(fps, False).withColumnRenamed("fp", "b")
    sought = keys_of(fps, True).withColumnRenamed("fp", "a")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return sought.join(filed, "key").filter(near).select("a", "b").distinct()


def classes(documents: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """id, fp, component_id: the least id that can be reached over links."""
    fps = materialize(fingerprints(documents, id_col, text, shingle), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    found = components(links(nodes, most), "simhash-links")
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


# Near duplicates by shingle similarity. Texts whose fingerprints the Golay keys link are compared first; an exact path finds the rest: two
# sets that are similar enough share one of the first n - ceil(similarity * n) + 1 of the n shingles of each, in any one order of all
# shingles. Texts are filed under these, so that every link shares a key, however the words that differ lie.
#: Common shingles come last in the order. They are those that so many texts, or the stated part of all texts, are filed under, by an
#: estimate from one text in SAMPLED: any order gives the same links, and this one gives few texts to a key.
COMMON, COMMON_PART, SAMPLED = 16, 4000, 8
#: The exact join begins when it compares at most so many pairs for each row filed, or when pivots no longer halve their number.
PAIRS_EACH = 64
#: Bits of a parity sketch of a text of up to PARITY_FOR shingles; twice as many for each doubling beyond.
PARITY, PARITY_FOR = 512, 1024
#: Groups of near copies are linked early over bands: texts whose least shingles agree under each of a band's hashes.
BANDS, BAND_HASHES = 6, 2
#: How many texts of each band the others are compared with, one turn after the other.
DRAWS = (4, 4)
#: Odd factors, which permute 64-bit hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts up to this number are picked by a broadcast of their hashes (about 100 bytes each), and keys up to this number by one of the keys
#: (8 bytes each); beyond, by joins on them.
MOST_BROADCAST, MOST_KEYS = 100_000, 200_000
#: Up to so many links the driver links the classes (some 200 bytes each); beyond, stars do.
MOST_LINKS = 100_000


def shingle_set(text: bytes, n: int) -> tuple[list[int], np.ndarray]:
    """The hashes of all shingles, and the distinct ones in ascending order."""
    each = shingle_hashes(text, n)
    return each, np.unique(np.array(each, dtype="<u8").view(np.int64))


def parity_of(known: np.ndarray) -> np.ndarray:
    """Whether each bin of hashes holds an odd number, as longs. The bins in which two sets differ, once the longer sketch is folded to the
    shorter, are never more than the shingles that only one of them holds."""
    bins = PARITY << max(0, int(np.ceil(np.log2(max(1, len(known)) / PARITY_FOR))))
    odd = np.bincount(known & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def bands_of(known: np.ndarray) -> np.ndarray:
    """A key for each band: its number and the shingles that come first by its hashes. No key for an empty set."""
    if not len(known):
        return np.zeros(0, np.int64)
    # Products are mixed once: their low bits depend on the low bits of a hash alone.
    mixed = np.stack([(h := known.view(np.uint64) * f) ^ (h >> np.uint64(32)) for f in FACTORS])
    least = mixed.min(axis=1).reshape(BANDS, BAND_HASHES)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED + i) for i, b in enumerate(least)], "<u8").view(np.int64)


def prefix_of(known: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The shingles that a set is filed under: the first by how common they are, and then by hash."""
    n = len(known)
    size = min(n, n - int(np.ceil(n * similarity - 1e-9)) + 1)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], known), len(common[0]) - 1)
        known = known[np.lexsort((known, np.where(common[0][at] == known, common[1][at], 0)))]
    return known[:size]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def common_shingles(documents: DataFrame, text: str, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles in ascending order, and how many sampled texts are filed under each. There are at most COMMON_PART of them for
    each shingle of a mean prefix, whatever the number of texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = documents.select(F.lower(t).alias("text"), F.xxhash64(t).alias("hash")).filter(F.pmod("hash", F.lit(SAMPLED)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), _lists([prefix_of(shingle_set(x.as_py(), shingle)[1], similarity) for x in b.column(0).cast(pa.binary())])], names=["hash", "prefix"])

    sample = materialize(d.mapInArrow(run, "hash long, prefix array<long>").groupBy("hash").agg(F.first("prefix").alias("prefix")), "near-sample")
    least = max(COMMON // SAMPLED, sample.count() // COMMON_PART)
    table = sample.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= least).orderBy("key").toArrow()
    drop(sample)
    return table["key"].to_numpy(), table["c"].to_numpy()


def sketches(documents: DataFrame, id_col: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """id, hash of the text, fp (the fingerprint), n distinct shingles, prefix, parity and bands, of the text in lower case."""
    common = documents.sparkSession.sparkContext.broadcast(common_shingles(documents, text, shingle, similarity))
    t = F.coalesce(F.col(text), F.lit(""))
    d = documents.select(F.col(id_col).alias("id"), F.unhex(F.md5(t)).alias("hash"), F.lower(t).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n, prefix, parity, bands = [], [], [], [], []
            for x in b.column(2).cast(pa.binary()):
                each, known = shingle_set(x.as_py(), shingle)
                fp.append(majority(each))
                n.append(len(known))
                prefix.append(prefix_of(known, similarity, common.value))
                parity.append(parity_of(known))
                bands.append(bands_of(known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), _lists(prefix), _lists(parity), _lists(bands)], names=["id", "hash", "fp", "n", "prefix", "parity", "bands"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, hash binary, fp long, n int, prefix array<long>, parity array<long>, bands array<long>")


def sets_of(documents: DataFrame, texts: DataFrame, nodes: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """node and set, the distinct shingle hashes, of those nodes."""
    wanted = materialize(texts.select("node", "id", "hash").join(nodes, "node"), "near-wanted")
    w = wanted.select(F.col("node").alias("_node"), F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    t = F.coalesce(F.col(text), F.lit(""))
    d = documents.select(F.col(id_col).alias("id"), t.alias("text"))
    d = d.join(F.broadcast(w) if w.count() <= MOST_BROADCAST else w, (F.col("id") == F.col("_id")) & (F.unhex(F.md5("text")) == F.col("_hash")))
    d = d.select(F.col("_node").alias("node"), F.lower("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(x.as_py(), shingle)[1] for x in b.column(1).cast(pa.binary())])], names=["node", "set"])

    out = materialize(d.mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set")), "near-sets")
    drop(wanted)
    return out


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets have the Jaccard similarity."""
    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = j.select("a", "b", F.size("x").alias("x"), F.size("y").alias("y"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.filter(F.col("both") >= similarity * (F.col("x") + F.col("y") - F.col("both")) - 1e-9).select("a", "b")


def with_nodes(texts: DataFrame) -> DataFrame:
    """Adds node, a number of each text: rows that share an id are nodes of their own if their texts differ."""
    salt = 0
    while True:
        got = texts.withColumn("node", F.xxhash64("hash", F.lit(salt)))
        if not got.groupBy("node").count().filter("count > 1").count():
            return got
        salt += 1


def code_pairs(texts: DataFrame) -> DataFrame:
    """a and b, distinct: each text with the least of its fingerprint, and the least of each two fingerprints that Golay keys link."""
    fps = materialize(texts.filter("n > 0").groupBy("fp").agg(F.min("node").alias("rep")), "near-fps")
    own = texts.filter("n > 0").join(fps, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    side = lambda x: fps.select(F.col("fp").alias(f"f{x}"), F.col("rep").alias(x))
    near = links(fps).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(side("a"), "fa").join(side("b"), "fb")
    return own.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def banded(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """key, node, n, at, alone: texts under their bands, if others stand there too. alone is the part of a prefix, in sixteenths, under
    which no other text is filed: of near copies, that from which they were made has the fewest shingles of its own."""
    keyed = texts.select("node", "n", F.lit(0).alias("at"), F.size("prefix").alias("filed"), F.explode("bands").alias("key"))
    keyed = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "key")
    keyed = keyed.join(filed.groupBy("node").agg(F.count("*").alias("shared")), "node", "left")
    return keyed.select("key", "node", "n", "at", F.floor(16 - 16 * F.coalesce("shared", F.lit(0)) / F.col("filed")).alias("alone"))


def shared_keys(texts: DataFrame) -> DataFrame:
    """key, node, n, at (the key's place in the node's order): texts under the shingles of their prefixes, if others stand there too. Keys are
    counted on the map side first, and a hot key's rows are split by adaptive execution."""
    filed = texts.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    several = materialize(filed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "near-keys")
    return filed.join(F.broadcast(several) if several.count() <= MOST_KEYS else several, "key")


def across_classes(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """The columns of shared (key, node and others) with root: the rows under keys that still hold more than one class."""
    rooted = shared.drop("root").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return rooted.join(several, "key", "left_semi")


def pairs_left(rooted: DataFrame) -> tuple[int, int]:
    """How many rows there are, and how many pairs of different classes stand under their keys."""
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("decimal(38,0)") * F.col("c")).alias("own"))
    got = each.agg(F.sum("m"), F.sum((F.col("m").cast("decimal(38,0)") * F.col("m") - F.col("own")) / 2)).first()
    return int(got[0] or 0), int(got[1] or 0)


def _fits(similarity: float, x: str, y: str) -> Column:
    """Whether two sets of n.. shingles that share the one at the places i.. of their orders may be similar, by their numbers alone. Of a
    pair's first common shingle, they share no more than stands from there on; for its later ones this may fail."""
    nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
    need = similarity / (1 + similarity) * (nx + ny) - 1e-6
    rest = F.least(nx - F.col(f"i{x}"), ny - F.col(f"i{y}")) >= need
    return rest & (F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-6)


def pivot_pairs(rooted: DataFrame, turn: int, similarity: float, draws: int = 1) -> DataFrame:
    """a and b, distinct: so many nodes of each key, drawn by hash (where rooted has alone, from those that have the least of it), with those
    of other classes under the key that may be similar."""
    own = F.struct(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("at").alias("ia"))
    by = [F.xxhash64("node", F.lit(turn))] if draws == 1 else [F.xxhash64("node", "key", F.lit(turn), F.lit(i)) for i in range(draws)]
    by = [F.struct("alone", x) for x in by] if "alone" in rooted.columns else by
    pivots = rooted.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(own, x) for x in by])).alias("p")).select("key", F.explode("p").alias("p")).select("key", "p.*")
    y = rooted.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    j = y.join(pivots, "key").filter((F.col("ra") != F.col("rb")) & _fits(similarity, "a", "b"))
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _folded(p: Column, n: Column) -> Column:
    """A sketch as long as n, where it is twice as long."""
    half = (F.size(p) / 2).cast("int")
    return F.when(F.size(p) > n, F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(p)


def _possible(similarity: float) -> Column:
    """Whether sets of na and nb shingles with parities pa and pb may have the similarity: a bound, which rules out no link."""
    odd = F.aggregate(F.zip_with(_folded(F.col("pa"), F.size("pb")), _folded(F.col("pb"), F.size("pa")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, c: acc + c)
    enough = odd * (1 + similarity) <= (1 - similarity) * (F.col("na") + F.col("nb")) + 1e-6
    return (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6) & enough


def _side(rooted: DataFrame, s: str) -> DataFrame:
    return rooted.select("key", *(F.col(c).alias(f"{t}{s}") for c, t in (("node", ""), ("root", "r"), ("n", "n"), ("at", "i"), ("parity", "p")) if c in rooted.columns))


def exact_pairs(rooted: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a and b, distinct: all pairs of different classes under a key that may be similar; the join itself tests this. Sketches go with
    those rows alone under whose key another class has a node that fits by its numbers."""
    fits = (F.col("ra") != F.col("rb")) & _fits(similarity, "a", "b")
    some = rooted.select("key", "node", "root", "n", "at").withColumnsRenamed({"node": "a", "root": "ra", "n": "na", "at": "ia"})
    some = some.join(_side(rooted, "b").withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & fits, "left_semi")
    some = some.withColumnsRenamed({"a": "node", "ra": "root", "na": "n", "ia": "at"})
    wide = materialize(some.join(texts.select("node", "parity"), "node"), "near-wide")
    j = _side(wide, "a").join(_side(wide, "b"), "key").filter((F.col("a") < F.col("b")) & fits & _possible(similarity))
    return j.select("a", "b").distinct()


def not_ruled_out(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) that the numbers of shingles and the parities leave possible."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("parity").alias(f"p{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_possible(similarity)).select("a", "b")


def near_classes(documents: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, hash of the text, class_id and class_hash: the least id, and then hash, of the documents that links of that similarity reach.

    Two texts are linked if their sets of shingles, in lower case, have the Jaccard similarity; no link is lost, and none is false.
    Equal texts are one node. First come the pairs whose SimHash fingerprints the Golay keys link. Then texts are filed under the
    shingles of their prefixes; under a key, all are compared with a node drawn by hash, again while this spares many pairs, and then
    every pair of different classes that is left under any key; a link within a class would change nothing. Pairs are
    ruled out by bounds alone, the numbers of shingles, the key's places and parity sketches, and what is left is compared set by
    set. Blank texts are nodes without links. Rows with null ids get no class. Very long texts have longer sketches; all their
    shingles count. Other columns aren't read.
    """
    rows = materialize(sketches(documents, id_col, text, shingle, similarity), "near")
    texts = rows.filter("id is not null").groupBy("hash").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("fp", "n", "prefix", "parity", "bands")])
    texts = with_nodes(materialize(texts, "near-texts"))

    def linked_by(pairs: DataFrame, tried: DataFrame | None, linked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The pairs that were compared, and the classes with those that are similar."""
        fresh_pairs = not_ruled_out(texts, pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), similarity)
        found = materialize(fresh_pairs, "near-pairs")
        sets = sets_of(documents, texts, found.select(F.col("a").alias("node")).unionAll(found.select("b")).distinct(), id_col, text, shingle)
        similar = similar_pairs(found, sets, similarity)
        if linked is not None:
            similar = similar.unionAll(linked.filter("node <> root").select("root", "node"))
        linked = components(similar, "near-links", MOST_LINKS)
        drop(sets)
        release(documents.sparkSession)
        return found if tried is None else tried.unionAll(found), linked

    tried, linked = linked_by(code_pairs(texts), None, None)
    filed = materialize(shared_keys(texts), "near-shared")
    bands = materialize(banded(texts, filed), "near-bands")
    for turn, draws in enumerate(DRAWS):
        tried, linked = linked_by(pivot_pairs(across_classes(bands, linked), turn, similarity, draws), tried, linked)
    drop(bands)
    shared, before, turn = materialize(across_classes(filed, linked), "near-across"), 0, 0
    drop(filed)
    while True:
        rows_left, left = pairs_left(shared)
        if not left:
            break
        last = turn > 0 and (left <= PAIRS_EACH * rows_left or 2 * left > before)
        before, turn = left, turn + 1
        tried, linked = linked_by(exact_pairs(shared, texts, similarity) if last else pivot_pairs(shared, turn, similarity), tried, linked)
        if last:
            break
        earlier, shared = shared, materialize(across_classes(shared, linked), "near-across")
        drop(earlier)
    drop(shared)
    nodes = materialize(texts.select("hash", "id", "node").join(linked, "node", "left").select("hash", "id", F.coalesce("root", "node").alias("root")), "near-roots")
    least = nodes.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("least"))
    found = nodes.join(least, "root").select("hash", F.col("least.id").alias("class_id"), F.col("least.hash").alias("class_hash"))
    return rows.select("id", "hash").join(found, "hash", "left")


def without_copies(documents: DataFrame) -> DataFrame:
    """One document of each class, that of the least id, in the columns of the input. Of rows with one id and text one stays; rows with a
    null id all stay, for no class has them."""
    mark, one, other = fresh(documents, "text_hash", "kept_id", "kept_hash")
    kept = materialize(near_classes(documents).filter("id = class_id and hash = class_hash").select(F.col("id").alias(one), F.col("hash").alias(other)).distinct(), "kept")
    d = documents.withColumn(mark, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    got = d.join(kept, (F.col("doc_id") == F.col(one)) & (F.col(mark) == F.col(other)), "left_semi")
    again = got.groupBy("doc_id", mark).count().filter("count > 1").select("doc_id", mark)
    cols = all_columns(documents)
    single = got.join(again, ["doc_id", mark], "left_anti").select(*cols)
    first = got.join(again, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(*cols)
    return single.unionByName(first).unionByName(documents.filter("doc_id is null"))
