"""N-gram Jaccard join: size-banded tiles with bitmap bounds before exact intersections.

1. Every text becomes its sorted set of shingle hashes (64 bits); equal sets are one class.
2. Two classes that link share one of the first n - ceil(t n) + 1 shingles of each, in any order
   common to all.  The order puts shingles last that very many texts hold (counted in a fixed
   table over all texts), so that a passage found everywhere does not bring its texts together.
   The classes behind such a shingle are a tile; equal tiles are kept once.  Tiles of many bytes
   are cut into size bands whose ratio allows a link, and those into blocks.
3. Every class has a hashed bitmap of two to four bits an element.  In a tile, bit counts bound
   the overlap of two classes from above.  Pairs that pass connect classes into groups; a tile
   reports a forest of them, fewer than it has classes.
4. In a group every class is first held against one of them by exact intersection of the sorted
   arrays.  Those without a link meet the others in tiles of the group, bound first, then exact.
5. Links make components.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import land, smallest_reachable, text_batches

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 3, 4
#: Buckets of the table that tells very frequent shingles (2 ** SKETCH_BITS).
SKETCH_BITS = 20
#: A shingle is frequent if its bucket has this share of all texts.
FREQUENT = 0.003
#: Set elements of one block of a tile.
BLOCK_ELEMENTS = 2_000_000
#: Rows of one shingle that a task holds at a time.
GROUP_ROWS = 200_000

_odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class WordHashes(dict):
    """Word to 64 hash bits, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes):
    """Sorted distinct hashes; one for a text of fewer than five words, none without words."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - width + 1, 0 if width == SHINGLE else width, np.uint64)
        for k in range(width):
            total += h[k : len(h) - width + 1 + k] * np.uint64(_odd[k])
        return np.unique(mixed(total))


def class_of(made) -> int | None:
    return int.from_bytes(hashlib.blake2b(made.tobytes(), digest_size=8).digest(), "little", signed=True) if len(made) else None


def width_of(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def bitmap(made) -> bytes:
    import numpy as np

    bits = np.zeros(width_of(len(made)), bool)
    bits[(made & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def prefix_length(n: int) -> int:
    return n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1


def described(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, class, map) of every row, and (bucket, times) of the buckets that partitions found frequent."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text_"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes, counts, texts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64), 0
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("map", pa.binary()), ("bucket", pa.int32()), ("times", pa.int64())])
        for batch in batches:
            for low in range(0, len(batch.column(2)), 500):
                sets = [shingle_set(t.as_py(), hashes) for t in batch.column(2).slice(low, 500)]
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                texts += len(sets)
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 500), batch.column(1).slice(low, 500), pa.array([len(x) for x in sets], pa.int64()), pa.array([class_of(x) for x in sets], pa.int64()),
                                                  pa.array([bitmap(x) for x in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
        often = np.flatnonzero(counts >= max(4, FREQUENT * texts, 8 * counts.mean())) if texts else []
        none = pa.nulls(len(often), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(often), pa.binary()), pa.array(often, pa.int32()), pa.array(counts[often] if texts else [], pa.int64())], schema=schema)

    made = land(text_batches(rows).mapInArrow(run, "doc_id long, th long, n long, class long, map binary, bucket int, times long"))
    return made.where("bucket is null").drop("bucket", "times"), made.where("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times"))


def sharing(docs: DataFrame, frequent: bytes, text_col: str) -> DataFrame:
    """(grp, class, n): classes that share a shingle of their prefixes; groups of equal members once."""

    def posts(batches):
        import numpy as np
        import pyarrow as pa

        hot = np.frombuffer(frequent, np.uint8)
        hashes, seen = WordHashes(), set()
        for batch in batches:
            keys, classes, sizes = [], [], []
            for text in batch.column(0):
                made = shingle_set(text.as_py(), hashes)
                own = class_of(made)
                if own is None or own in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(own)
                late = hot[(made >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(bool)
                first = np.concatenate([made[~late], made[late]])[: prefix_length(len(made))]
                keys.append(first.view(np.int64))
                classes.append(np.full(len(first), own, np.int64))
                sizes.append(np.full(len(first), len(made), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, classes, sizes)], names=["key", "class", "n"])

    def grouped(batches):
        import numpy as np
        import pyarrow as pa

        seen: set[int] = set()
        held, running = None, None  # running: the key of which a part has gone out
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None:
                new = [batch.column(i).to_numpy() for i in range(3)]
                rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if rows is None or not len(rows[0]):
                continue
            key, own, n = rows
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if batch is not None and last == 0 and len(key) < GROUP_ROWS:
                held = rows  # all of one key so far
                continue
            cut = len(key) if batch is None or last == 0 else last
            held = None if cut == len(key) else [x[cut:] for x in rows]
            key, own, n = key[:cut], own[:cut], n[:cut]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            key, own, n = key[fresh], own[fresh], n[fresh]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            # Equal groups have equal sums of their members' hashes; a group that goes out in parts is known by its key.
            total = mixed(np.add.reduceat(mixed(own.view(np.uint64)), starts) + sizes.astype(np.uint64))
            if batch is not None and last == 0:
                running = key[0]
            part = key[starts] == running if running is not None else np.zeros(len(starts), bool)
            name = np.where(part, key[starts], total.view(np.int64))
            keep = (sizes > 1) | part
            for i in np.flatnonzero(keep & ~part):
                keep[i] = int(name[i]) not in seen
                seen.add(int(name[i]))
            if len(seen) > 2_000_000:
                seen.clear()
            rows_kept = np.repeat(keep, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[rows_kept]), pa.array(own[rows_kept]), pa.array(n[rows_kept])], names=["grp", "class", "n"])

    listed = docs.select(F.col(text_col).cast("string").alias("text_")).mapInArrow(posts, "key long, class long, n int")
    return listed.repartition("key").sortWithinPartitions("key", "n", "class").mapInArrow(grouped, "grp long, class long, n int").distinct()


def dealt(members: DataFrame) -> DataFrame:
    """``members`` (grp, class, n, ...) with tile and side, each row once for every tile it is in.

    A group of few elements is one tile.  Others are cut into size bands, bands into blocks by a
    hash; a tile is a block with itself, or two blocks of one band or of neighbouring bands
    (side 0 and 1), so that every pair whose sizes allow a link is in a tile.
    """
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"))
    sized = members.join(totals, "grp")
    whole = sized.where(F.col("total") <= BLOCK_ELEMENTS).select(*members.columns, F.col("grp").cast("string").alias("tile"), F.lit(0).alias("side"))
    banded = sized.where(F.col("total") > BLOCK_ELEMENTS).withColumn("band", F.floor(F.log("n") / math.log(1.34)).cast("int"))
    blocks = banded.groupBy("grp", "band").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("cut"))
    near = blocks.alias("x").join(blocks.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1)).groupBy("x.grp", "x.band").agg(
        F.max("x.cut").alias("cut"), F.coalesce(F.max(F.when(F.col("y.band") < F.col("x.band"), F.col("y.cut"))), F.lit(0)).alias("below"),
        F.coalesce(F.max(F.when(F.col("y.band") > F.col("x.band"), F.col("y.cut"))), F.lit(0)).alias("above"))
    placed = banded.join(near, ["grp", "band"]).withColumn("x_", F.pmod(F.xxhash64("class"), F.col("cut")).cast("int"))
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda *parts: F.concat_ws("/", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    same = F.transform(many(F.col("cut")), lambda y: F.struct(name("grp", "band", F.least("x_", y), "band", F.greatest("x_", y)).alias("tile"), (F.col("x_") > y).cast("int").alias("side")))
    up = F.transform(many(F.col("above")), lambda y: F.struct(name("grp", "band", "x_", F.col("band") + 1, y).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(many(F.col("below")), lambda y: F.struct(name("grp", F.col("band") - 1, y, "band", "x_").alias("tile"), F.lit(1).alias("side")))
    cut = placed.select(*members.columns, F.explode(F.concat(same, up, down)).alias("t")).select(*members.columns, "t.tile", "t.side")
    return whole.unionByName(cut)


def in_tiles(rows: DataFrame, work) -> DataFrame:
    """(a, b) from ``work`` on the rows of each tile; rows have tile, side, class and what else work takes."""
    names = [c for c in rows.columns if c != "tile"]

    def run(batches):
        import pyarrow as pa

        a, b, held, tile = [], [], None, None

        def done():
            if held is not None and len(held["class"]) > 1:
                for i, j in work(held):
                    a.append(held["class"][i])
                    b.append(held["class"][j])

        for batch in batches:
            tiles = batch.column(0).to_pylist()
            columns = {n: batch.column(i + 1).to_pylist() for i, n in enumerate(names)}
            start = 0
            for end in range(1, len(tiles) + 1):
                if end < len(tiles) and tiles[end] == tiles[start]:
                    continue
                if tiles[start] != tile:
                    done()
                    tile, held = tiles[start], {n: [] for n in names}
                for n in names:
                    held[n] += columns[n][start:end]
                start = end
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a.clear()
                b.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("tile", *names).repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def linked(a, b) -> bool:
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= (len(a) + len(b) - both) * NUMERATOR


def forest(sizes, maps, sides, tied, exact=None):
    """Index pairs whose overlap bound allows a link and, if given, exact(i, j) holds: enough to connect all such, no more.

    maps: bitmaps as bytes, their width following the size.  A bit that only one of two classes
    has stands for an element that the other lacks; a wider bitmap is folded to the narrower one.
    sides: 0 and 1 for a tile of two blocks, compared across.  `tied` ones are connected beforehand.
    """
    import numpy as np

    order = np.argsort(sizes, kind="stable")
    n, sides = np.asarray(sizes, np.int64)[order], np.asarray(sides)[order]
    raw = [np.frombuffer(maps[i], np.uint64) for i in order]
    first = {}  # width: (first index, matrix, the matrix folded once)
    words = np.array([len(r) for r in raw])
    for w in np.unique(words):
        own = np.stack([raw[i] for i in np.flatnonzero(words == w)])
        first[int(w)] = int(np.searchsorted(words, w)), own, own[:, : w // 2] | own[:, w // 2 :] if w > 1 else own
    group = np.arange(len(n))
    if tied is not None:
        group[np.asarray(tied, bool)[order]] = -1
    found, two = [], bool(sides.any())
    for i in range(len(n)):
        top = int(np.searchsorted(n, n[i] * DENOMINATOR // NUMERATOR, "right"))
        mine, w = raw[i], int(words[i])
        for width in (w, 2 * w):
            if width not in first:
                continue
            begin, own, folded = first[width]
            low, high = max(i + 1, begin), min(top, begin + len(own))
            table = own if width == w else folded
            for at in range(low, high, 4096):
                some = np.arange(at, min(high, at + 4096))
                some = some[(group[some] != group[i]) & ((sides[some] != sides[i]) | (not two))]
                if not len(some):
                    continue
                theirs = table[some - begin]
                only_i = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
                only_j = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
                bound = np.minimum(n[i] - only_i, n[some] - only_j)
                for j in some[bound * (NUMERATOR + DENOMINATOR) >= (n[i] + n[some]) * NUMERATOR]:
                    if group[j] != group[i] and (exact is None or exact(order[i], order[j])):
                        found.append((order[i], order[j]))
                        old, new = (group[j], group[i]) if group[j] != -1 else (group[i], group[j])
                        group[group == old] = new
    return found


def links_of(docs: DataFrame, facts: DataFrame, frequent: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): classes that link, enough of them to connect every component."""
    texts = facts.count()
    hot = bytearray(1 << SKETCH_BITS)  # fixed size
    for row in frequent.where(F.col("times") >= max(4, FREQUENT * texts)).select("bucket").toLocalIterator():
        hot[row["bucket"]] = 1
    shares = land(sharing(docs, bytes(hot), text_col))
    maps = facts.where("class is not null").groupBy("class").agg(F.min("map").alias("map"))
    near = in_tiles(dealt(shares).join(maps, "class").select("tile", "side", "class", "n", "map"), lambda rows: forest(rows["n"], rows["map"], rows["side"], None))
    groups = smallest_reachable(near).select(F.col("node").alias("class"), F.col("root").alias("grp"))
    # One row stands for a class, known by id and text: an id may be null or have other texts.
    first = facts.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row"))
    wanted = first.join(groups, "class").select(F.col("class").alias("want"), F.col("row.doc_id").alias("key_"), F.col("row.th").alias("hash_"), "grp")
    texts_of = docs.select(F.col(id_col).cast("long").alias("own_"), F.xxhash64(F.col(text_col)).alias("th_"), F.col(text_col).cast("string").alias("text_"))
    met = texts_of.join(wanted, texts_of["own_"].eqNullSafe(wanted["key_"]) & (texts_of["th_"] == wanted["hash_"])).select("want", "grp", "text_")

    def rebuilt(batches):
        import pyarrow as pa

        hashes, seen = WordHashes(), set()
        for batch in batches:
            rows = []
            for w, g, t in zip(*(c.to_pylist() for c in batch.columns)):
                if w in seen:  # a row that is there more than once
                    continue
                made = shingle_set(t, hashes)
                if class_of(made) == w:
                    rows.append((w, g, made))
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(w)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int32()),
                                              pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["class", "grp", "n", "set"])

    members = land(met.mapInArrow(rebuilt, "class long, grp long, n int, set binary"))
    heads = members.where("class = grp").select(F.col("grp").alias("head"), F.col("set").alias("head_set")).dropDuplicates(["head"])

    def against_head(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own, grp, sets, heads_ = (c.to_pylist() for c in batch.columns)
            tied = [o == g or linked(np.frombuffer(s, np.uint64), np.frombuffer(h, np.uint64)) for o, g, s, h in zip(own, grp, sets, heads_)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tied, pa.bool_())], names=["class", "grp", "tied"])

    compared = members.join(heads, members["grp"] == heads["head"]).select("class", "grp", "set", "head_set")
    tied = land(compared.mapInArrow(against_head, "class long, grp long, tied boolean").distinct())
    links = tied.where("tied and class <> grp").select(F.col("class").alias("a"), F.col("grp").alias("b"))
    open_ = tied.where("not tied").select("grp").distinct()
    rest = members.join(open_, "grp", "left_semi").join(tied, ["class", "grp"])

    def exact(rows):
        import numpy as np

        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        return forest(rows["n"], [bitmap(x) for x in sets], rows["side"], rows["tied"], lambda i, j: linked(sets[i], sets[j]))

    return links.unionByName(in_tiles(dealt(rest).select("tile", "side", "class", "n", "tied", "set"), exact))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, th, n_shingles, class, component_id, first (id and class of the component's smallest document).

    Links: 100 * intersection >= 75 * union of the sets of five-word shingles (the whole text if
    it has fewer words).  Null, empty and wordless texts link with nothing and are components of
    their own.  Rows that share an id are told apart by text.  Rows with a null id link like
    others; they come last, and a component has a null id if it has no other.
    """
    facts, frequent = described(docs, id_col, text_col)
    roots = smallest_reachable(links_of(docs, facts, frequent, id_col, text_col))
    least = facts.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    named = least.join(roots, least["class"] == roots["node"], "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("first"))
    known = named.join(best, "root").select(F.col("class").alias("class_"), F.struct("first.doc_id", "first.class").alias("first"))
    out = facts.join(known, facts["class"] == known["class_"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "class", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near duplicates: of each component the document of the smallest id stays, once; texts without words all stay.

    Rows of one id, null ids too, that are in different components stay one for each; of rows that
    are equal in id and text one stays.  Texts of any length are compared whole.  All columns are
    returned as they are, whatever they are called.
    """
    found = near_duplicates(docs, id_col, text_col)
    keep = found.where("class is null or (doc_id <=> first.doc_id and class = first.class)").select(F.col("doc_id").alias("k_"), F.col("th").alias("t_"), F.col("class").alias("c_")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id_"), F.xxhash64(F.col(f"`{text_col}`")).alias("h_"))
    met = rows.join(keep, rows["id_"].eqNullSafe(keep["k_"]) & (rows["h_"] == keep["t_"]))
    single = met.where("c_ is not null").dropDuplicates(["k_", "c_"])  # of a component one class stays
    return single.unionByName(met.where("c_ is null")).select("row.*")
