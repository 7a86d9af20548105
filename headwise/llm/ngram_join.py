"""N-gram Jaccard join: MinHash bands propose pairs of texts, full n-gram sets decide.

Words are the lower-case runs between white spaces, and a text's set holds its runs of five words (one shorter run if it
has fewer). Two different texts are linked if the Jaccard similarity of their sets is 0.8 or more. Rows and bands are
chosen so that a pair at the threshold shares a band with the target probability, with as long bands as the number of
hashes allows.

Equal texts are one text with a number of copies. Texts that share a band are candidates; their candidate components
are found on narrow rows, and then each text's set is sent once, to the task that checks its component. Components of
more than ``block`` texts are checked band by band instead, in tiles of two blocks, each pair in the first band that its
texts share. A tile counts links and keeps a forest of them, so that pairs are never rows: a group of n copies or near
copies costs its comparisons, not n^2 output. Classes are the components of the links.

Keys of texts are 64-bit hashes, told apart by a second one: texts that share the first hash only get a key made of both,
so that copies agree in 128 bits.

Edge cases: a null text is empty; empty texts are copies of each other and similar to nothing else; a class is named by
its smallest id, null if it has none; repeated rows and ids are copies or near copies like others and count as links; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import by_bytes, fresh, give_back, groups, sole_memory, text_of, written
from headwise.llm.components import components

WORDS = 5
#: Similarity at which texts are linked, as a fraction.
THRESHOLD = (4, 5)
REMEMBERED = 200_000
AT_ONCE = 1 << 22


def bands_and_rows(threshold: float = 0.8, recall: float = 0.995, hashes: int = 256) -> tuple[int, int]:
    """The longest bands with which a pair at the threshold is found with the target recall."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


BANDS, ROWS = bands_and_rows()
_RNG = np.random.default_rng(4)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PLACE = (_RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed word runs; a worker remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """The sorted set, as unsigned 64-bit hashes."""
        words = text.lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
        n = max(1, len(h) - WORDS + 1)
        run = np.zeros(n, dtype=np.uint64)
        for i in range(min(WORDS, len(h))):
            run += h[i : i + n] * _PLACE[i]
        return np.unique(_mix(run + np.uint64(min(WORDS, len(h)))))


@lru_cache(maxsize=1)
def _shingler() -> Shingler:
    return Shingler()


def shingler() -> Shingler:
    """The worker's shingler."""
    sole_memory("shingles", _shingler.cache_clear)
    return _shingler()


def buckets(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the MinHash signature; none for an empty set."""
    if not len(shingles):
        return np.empty(0, dtype=np.int64)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 1024):
        hashed = np.multiply.outer(low[i : i + 1024], _TIMES)
        hashed += _PLUS
        np.minimum(least, hashed.min(axis=0), out=least)
    key = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = _mix(key ^ column)
    return key.view(np.int64)


def linked_pairs(keys: np.ndarray, sets: list[np.ndarray], band: int | None, block: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Pairs of similar texts among those that share a band.

    With a ``band``, texts that share it and no band before it; with two blocks, a text of each.
    """
    size = np.array([len(s) for s in sets])
    whole: dict[int, frozenset] = {}
    n = len(sets)
    if band is None:
        found = set()
        for column in keys.T:
            order = np.argsort(column, kind="stable")
            cuts = np.nonzero(np.diff(column[order]))[0] + 1
            for some in np.split(order, cuts):
                if len(some) > 1:
                    some = np.sort(some)
                    a, b = np.triu_indices(len(some), 1)
                    found.update((some[a] * n + some[b]).tolist())
        candidates = (divmod(x, n) for x in found)
    else:
        candidates = _in_band(keys, band, block)
    up, down = THRESHOLD
    for i, j in candidates:
        x, y = size[i], size[j]
        if min(x, y) * down < max(x, y) * up:
            continue
        for k in (i, j):
            if k not in whole:
                whole[k] = frozenset(sets[k].tolist())
        both = len(whole[i] & whole[j])
        if both * down >= (x + y - both) * up:
            yield i, j


def _in_band(keys: np.ndarray, band: int, block: np.ndarray | None) -> Iterator[tuple[int, int]]:
    for i in range(len(keys) - 1):
        other = np.arange(i + 1, len(keys))
        if block is not None and block[0] != block[-1]:
            other = other[block[other] != block[i]]
        earlier = (keys[other, :band] == keys[i, :band]).any(axis=1)
        for j in other[~earlier].tolist():
            yield i, j


def _forest(n: int, pairs: Iterator[tuple[int, int]], copies: list[int]) -> tuple[list[int], list[int]]:
    """Root of each text, and how many rows each is linked to."""
    root, links = list(range(n)), [0] * n

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        links[i] += copies[j]
        links[j] += copies[i]
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)], links


_SIGNED = "doc_id long, k long, h2 long, bands array<long>"
_TILED = "tile long, band int, block int, k long, copies long, bands binary, shingles binary"


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def second_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(1), text)


Rekey = Callable[[DataFrame, str, str], DataFrame]


def told_apart(signed: DataFrame) -> Rekey:
    """What gives texts of one key and different second hashes keys of their own; mostly there are none."""
    ranges = signed.groupBy("k").agg(F.min("h2").alias("low"), F.max("h2").alias("high"))
    shared = written(ranges.where("low != high").select(F.col("k").alias("_shared_key")), "shared-keys")
    if not shared.limit(1).count():
        return lambda df, k, h2: df

    def rekey(df: DataFrame, k: str, h2: str) -> DataFrame:
        own = F.when(F.col("_shared_key").isNull(), F.col(k)).otherwise(F.xxhash64(k, h2))
        return df.join(shared, F.col(k) == F.col("_shared_key"), "left").withColumn(k, own).drop("_shared_key")

    return rekey


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> tuple[DataFrame, DataFrame, Rekey]:
    """Rows (doc_id, k), texts (k, rep_id, copies, label, links), and what turns a text's two hashes into its key.

    The class of a text is its label.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumns({"k": text_key(F.col("text")), "h2": second_hash(F.col("text"))})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shingler()
        for some in by_bytes(batches, "text", AT_ONCE):
            signed = [buckets(one.shingles(t)) for t in some.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in signed]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signed)))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("k"), some.column("h2"), lists], names=["doc_id", "k", "h2", "bands"])

    signed = written(rows.select("doc_id", "text", "k", "h2").mapInArrow(sign, _SIGNED), "signatures")
    rekey = told_apart(signed)
    signed, rows = rekey(signed, "k", "h2"), rekey(rows, "k", "h2").drop("h2")
    texts = written(signed.groupBy("k").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies")), "texts")
    in_bands = signed.select("k", F.explode("bands").alias("group"))
    shared = in_bands.groupBy("group").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low != high").select("group")
    members = written(in_bands.join(shared, "group").distinct(), "band-members")
    candidates = written(components(members), "candidates")

    sizes = candidates.groupBy("label").count()
    large = written(candidates.join(sizes.where(F.col("count") > block), "label").select("k"), "large-candidates")
    whole = candidates.join(large, "k", "left_anti").select("k", F.col("label").alias("tile"), F.lit(-1).alias("band"), F.lit(0).alias("block"))
    in_large = members.join(large, "k", "left_semi")
    parts = in_large.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where(F.col("parts") > 0)
    own = F.pmod(F.xxhash64(F.col("k"), F.lit(7)), F.col("parts")).cast("int")
    tiled = in_large.join(parts, "group").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by_band = tiled.select(
        "k",
        F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
        F.lit(0).alias("band"),
        F.when(F.col("parts") > 1, F.col("block") * 2 + (F.col("block") != F.col("other")).cast("int")).otherwise(0).alias("block"),
        "group",
    )
    # Where each text's set goes: a component, or for each of its bands a row of tiles.
    sent = whole.withColumn("group", F.lit(0).cast("long")).unionByName(by_band)
    sent = sent.groupBy("k").agg(F.collect_list(F.struct("tile", "band", "block", "group")).alias("tiles"))
    wanted = written(sent.join(texts, "k"), "wanted-texts")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shingler()
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["tile", "band", "block", "k", "copies", "bands", "shingles"]
        out: list[list] = [[] for _ in names]
        size = 0
        for some in by_bytes(batches, "text", AT_ONCE):
            for r in some.to_pylist():
                shingles = one.shingles(r["text"])
                keys = buckets(shingles)
                place = {g: b for b, g in enumerate(keys.tolist())}
                for t in r["tiles"]:
                    band = -1 if t["band"] < 0 else place[t["group"]]
                    row = (t["tile"], band, t["block"], r["k"], r["copies"], keys.tobytes(), shingles.tobytes())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += shingles.nbytes + keys.nbytes
                    if size > 2 * AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                        out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "tile"):
            seen: dict[int, dict] = {}
            for r in table.to_pylist():
                seen.setdefault(r["k"], r)  # a row that is repeated whole
            members_ = sorted(seen.values(), key=lambda r: (r["block"], r["k"]))
            if len(members_) < 2:
                continue
            keys = np.stack([np.frombuffer(r["bands"], np.int64) for r in members_])
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in members_]
            band = members_[0]["band"]
            blocks = np.array([r["block"] for r in members_])
            pairs = linked_pairs(keys, sets, None if band < 0 else band, blocks if band >= 0 else None)
            root, links = _forest(len(members_), pairs, [r["copies"] for r in members_])
            linked = [i for i, n in enumerate(links) if n]
            if linked:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([members_[i]["k"] for i in linked], pa.int64()),
                        pa.array([members_[root[i]]["k"] for i in linked], pa.int64()),
                        pa.array([links[i] for i in linked], pa.int64()),
                    ],
                    names=["k", "group", "links"],
                )
        give_back()

    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Candidates grow with the corpus, so both sides are shuffled at every size.
    chosen = rows.join(wanted.hint("merge"), ["k"]).where(F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("k", "text", "tiles", "copies")
    tiles = chosen.mapInArrow(tile, _TILED).repartition(tasks, "tile").sortWithinPartitions("tile")
    found = written(tiles.mapInArrow(check, "k long, group long, links long"), "links")
    classes = components(found.select("group", "k"))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = texts.join(classes, "k", "left").join(links, "k", "left")
    classes = named.select("k", "rep_id", "copies", F.coalesce("label", "k").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    return signed.select("doc_id", "k"), written(classes, "text-classes"), rekey


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """Class and number of linked rows of each row: doc_id, class_id, n_links."""
    rows, texts, _ = similar(df, id_col, text_col, block)
    ids = texts.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    named = written(texts.join(ids, "label").select("k", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "named-texts")
    return rows.join(named, "k").select("doc_id", "class_id", "n_links")


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns: of its texts the one with the smallest id, of equal rows one.

    Ids that are null come last.
    """
    _, texts, rekey = similar(df, id_col, text_col)
    rank = F.struct(F.col("rep_id").isNull().alias("unnamed"), F.col("rep_id").alias("kept_id"), F.col("k").alias("kept_k"))
    first = texts.groupBy("label").agg(F.min(rank).alias("r")).select("r.kept_k", "r.kept_id")
    k_, id_, key_, second_, place_ = fresh(df, "kept_k", "kept_id", "text_key", "second_hash", "place")
    kept = written(first.select(F.col("kept_k").alias(k_), F.col("kept_id").alias(id_)), "kept-texts")
    rows = rekey(df.withColumns({key_: text_key(text_of(text_col)), second_: second_hash(text_of(text_col))}), key_, second_)
    rows = rows.join(kept, (F.col(key_) == F.col(k_)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)))
    order = [F.col(f"`{c}`") for c, kind in df.dtypes if c != text_col and "map<" not in kind and kind != "variant"]
    ranked = rows.withColumn(place_, F.row_number().over(Window.partitionBy(key_).orderBy(*order)))
    return ranked.where(F.col(place_) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
