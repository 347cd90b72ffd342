"""Near-duplicates by 64-bit fingerprints, compared through a table of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import components, documents, folded
from heatgrid.session import cut_lineage, distilled

WIDTH = 4  # words of a shingle
RADIUS = 4  # differing bits of a link
BLOCKS = 6  # bit blocks of a fingerprint: a link leaves BLOCKS - RADIUS of them equal
SEED = 42
STEP = 1 << 16  # shingles hashed at once
#: Reference fingerprints, from a fixed seed: eight to a packed coordinate column.
PIVOTS = [int(x) for x in np.random.default_rng(20260101).integers(-(1 << 63), 1 << 63, 16, dtype=np.int64)]
#: Likeness of whole texts: four in five of their distinct shingles of five words are shared. Candidates agree in one of
#: BANDS bands of ROWS smallest hashes: a pair of likeness j meets with probability 1 - (1 - j^ROWS)^BANDS, 0.9993 at 0.8.
ALIKE_WIDTH, ALIKE, BANDS, ROWS = 5, (4, 5), 24, 6
LOOSE = 0.65  # part of two sketches that agrees if the texts are to be compared: 4.5 standard errors below ALIKE
FAR = 0.5  # part of two sketches that agrees if their shingles are to be fetched: 9 standard errors below ALIKE
BLOCK = 1 << 11  # shingles permuted at once

#: The permutations behind the smallest hashes, from a fixed seed: a flip and an odd factor each.
_FLIPS, _FACTORS = np.random.default_rng(20260106).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_FACTORS = _FACTORS | np.uint32(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def shingles(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, some at a time; fewer words than ``width`` are one shingle, none give none."""
    canon, starts, ends = folded(text or b"")
    if len(starts):
        starts, ends = (starts[: len(starts) - width + 1], ends[width - 1 :]) if len(starts) >= width else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        a, b = starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist()
        yield np.fromiter((digest(canon[i:j], SEED) for i, j in zip(a, b)), dtype=np.uint64, count=len(a))


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64; 0 without words. Signed, as Spark holds it."""
    votes, n = np.zeros(2048, dtype=np.int64), 0
    for hashes in shingles(text, width):
        n += len(hashes)
        votes += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
    ones = (votes.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def shingle_set(text: bytes | None, width: int = ALIKE_WIDTH) -> np.ndarray:
    """Distinct shingle hashes in order; none without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, width)]))


def set_digest(hashes: np.ndarray) -> int:
    """XXH3 of a set of shingles: texts with the same set are one node. Signed, as Spark holds it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """16 bits of the smallest hash under each permutation."""
    low, short = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32), hashes.astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        low = np.minimum(low, ((short[at : at + BLOCK] ^ _FLIPS) * _FACTORS).min(axis=1))
    return ((low ^ (low >> np.uint32(16))) & np.uint32(0xFFFF)).astype("<u2").tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_mark, print, fp, sketch) of every row; print is its :func:`fingerprint`, fp the digest of the text's shingles, text_mark the text's XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, prints, found, held = [], [], [], []
            for text in (t.as_py() or b"" for t in batch.column("text")):
                hashes = shingle_set(text)
                marks.append(xxhash.xxh64_intdigest(text, SEED))
                prints.append(fingerprint(text))
                found.append(set_digest(hashes))
                held.append(sketch(hashes))
            arrays = [batch.column("doc_id"), pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(found, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_mark", "print", "fp", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_mark bigint, print bigint, fp bigint, sketch binary")


def alike(pairs: DataFrame, nodes: DataFrame, least: float = LOOSE) -> DataFrame:
    """The pairs (u, v, any others) of nodes whose sketches (fp, sketch) agree in ``least`` of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, BANDS * ROWS) for c in ("sketch_u", "sketch_v"))
            yield batch.filter(pa.array((a == b).mean(axis=1) >= least)).drop_columns(["sketch_u", "sketch_v"])

    both = pairs.join(nodes.select(F.col("fp").alias("u"), F.col("sketch").alias("sketch_u")), "u")
    both = cut_lineage(both).join(nodes.select(F.col("fp").alias("v"), F.col("sketch").alias("sketch_v")), "v")
    kept = both.select(*pairs.columns, "sketch_u", "sketch_v")
    return kept.mapInArrow(run, pairs.schema)


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the nodes ``wanted`` (fp, first): the distinct shingle hashes, read from the document ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for n, text in enumerate(batch.column("text"), 1):
                held.append(shingle_set(text.as_py()))
                size += len(held[-1])
                if size > STEP or n == batch.num_rows:
                    arrays = [pa.array(map(set_digest, held), pa.int64()), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["fp", "shingles"])
                    held, size = [], 0

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(wanted.select("first").distinct(), F.col("doc_id") == F.col("first"), "left_semi")
    read = rows.select("text").mapInArrow(run, "fp bigint, shingles array<bigint>")
    return read.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.any_value("shingles").alias("shingles"))


def settled(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v, any others) whose shingles (fp, shingles) have a Jaccard likeness of ALIKE or more."""
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("set_u")), "u")
    both = both.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("set_v")), "v")
    return both.where(_likeness("set_u", "set_v")).select(*pairs.columns)


def _likeness(a: str, b: str) -> Column:
    """Whether two sets of shingles have a Jaccard likeness of ALIKE or more."""
    return sum(ALIKE) * F.size(F.array_intersect(a, b)) >= ALIKE[0] * (F.size(a) + F.size(b))


def _distances(fp: Column, pivots: list[int]) -> Column:
    """Distances to eight reference fingerprints, one in each byte of a bigint."""
    out = F.lit(0).cast("bigint")
    for i, p in enumerate(pivots):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i))
    return out


def _near(a: str, b: str, radius: int) -> Column:
    """Every coordinate of the distance table differs by ``radius`` at most."""
    ok = F.lit(True)
    for name in ("p0", "p1"):
        for i in range(8):
            lane = lambda side: F.shiftright(F.col(f"{side}.{name}"), 8 * i).bitwiseAND(F.lit(255))  # noqa: B023, E731
            ok = ok & (F.abs(lane(a) - lane(b)) <= radius)
    return ok


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Fingerprints within the radius agree in the bits of one of these masks: some choice of blocks - radius blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _keys(fp: Column, masks: list[int]) -> Column:
    """(choice, key): a hash of the bits under each mask. Buckets that share a hash by chance do no harm."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(m))).alias("key")) for n, m in enumerate(signed)]))


def _bands(sketch: Column) -> Column:
    """(choice, key): a hash of each band of a sketch."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(F.lit(n), F.substring(sketch, 2 * ROWS * n + 1, 2 * ROWS)).alias("key")) for n in range(BANDS)]))


def links(fps: DataFrame, radius: int = RADIUS, masks: list[int] | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root); root stands for the component.

    Fingerprints meet in buckets of equal bits, see :func:`_joined`; pairs whose coordinates in the distance table differ
    by more than the radius are discarded, and the survivors are verified. With :func:`block_masks` no link between
    different components is missed.
    """
    masks = masks or block_masks(radius)
    nodes = cut_lineage(fps.select("fp", _distances(F.col("fp"), PIVOTS[:8]).alias("p0"), _distances(F.col("fp"), PIVOTS[8:]).alias("p1")))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    return _joined(nodes, _keys(F.col("fp"), masks), len(masks), F.bit_count(F.col("head").bitwiseXOR(F.col("fp"))) <= radius, _near("a", "b", radius) & close)


def _headed(nodes: DataFrame, keys: Column, choices: int, held: Column, within: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (fp, any others) -> the same with comp and size, after holding every bucket's members against one of them."""
    draws = [int(x) for x in np.random.default_rng(20260105).integers(-(1 << 63), 1 << 63, choices, dtype=np.int64)]
    keyed = nodes.select("fp", keys.alias("k")).select("k.key", "fp", F.col("fp").bitwiseXOR(F.get(F.array(*[F.lit(d) for d in draws]), F.col("k.choice"))).alias("drawn"), "k.choice")
    heads = keyed.groupBy("key").agg(F.count("fp").alias("n"), F.min("drawn").alias("low"), F.min("choice").alias("choice"))
    head = F.col("low").bitwiseXOR(F.get(F.array(*[F.lit(d) for d in draws]), F.col("choice")))
    heads = cut_lineage(heads.where("n > 1").select("key", head.alias("head")))
    met = keyed.select("key", "fp").join(heads, "key").where(held & (F.col("head") != F.col("fp")))
    first = cut_lineage(components(within(met.select(F.col("fp").alias("u"), F.col("head").alias("v")))))

    sizes = first.groupBy("root").agg(F.count("node").alias("size"))
    first = cut_lineage(first.join(cut_lineage(sizes), "root"))
    known = nodes.join(first, nodes.fp == first.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    return cut_lineage(known)


def _joined(nodes: DataFrame, keys: Column, choices: int, held: Column, near: Column) -> DataFrame:
    """Nodes (fp, any others) that meet in buckets -> (fp, root).

    First every bucket's members are held against one of them, drawn anew for every choice of buckets; this alone joins a
    group of near copies, however many they are. Then only buckets that still hold several components are searched:
    members outside the bucket's largest component meet the others. So a group of copies is never expanded into its
    pairs. ``held`` is the condition on a member and its head, ``near`` that on a pair (a, b).
    """
    others = [c for c in nodes.columns if c != "fp"]
    known = _headed(nodes, keys, choices, held, lambda pairs: pairs)
    keyed = known.select("*", keys.alias("k")).select("k.key", "fp", *others, "comp", "size")
    mixed = keyed.groupBy("key").agg(F.max_by("comp", "size").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = cut_lineage(mixed.where("lo <> hi").select("key", "main"))
    rows = cut_lineage(keyed.drop("size").join(mixed, "key"))
    a, b = rows.where("comp <> main").drop("main").alias("a"), rows.drop("main").alias("b")
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & near)
    found = found.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), F.col("a.comp").alias("cu"), F.col("b.comp").alias("cv"))
    more = components(found.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    return known.join(more, known.comp == more.node, "left").select("fp", F.coalesce("root", "comp").alias("root"))


def _agreeing(a: Column, b: Column) -> Column:
    """Part of two sketches that agrees."""
    n = BANDS * ROWS
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2)))) / F.lit(n)


def _facing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets (key, comp, main, sketch, any others) -> those outside the main component that have a partner in their bucket, and the partners.

    Partners are of another component, and their sketches agree in FAR. Each row is kept once, however many partners it has.
    """
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & (_agreeing(F.col("a.sketch"), F.col("b.sketch")) >= FAR)
    rows = cut_lineage(rows)
    a = cut_lineage(rows.where("comp <> main").alias("a").join(rows.alias("b"), meets, "left_semi"))
    b = cut_lineage(rows.alias("b").join(a.alias("a"), meets, "left_semi"))
    return a.drop("sketch"), b.drop("sketch")


def _alike_roots(nodes: DataFrame, within: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (fp, sketch) -> (fp, root), joined by every pair that meets in a band and is a link.

    Every bucket's members are held against one of them; this alone joins a group of near copies. In buckets that still
    hold several components, members outside the largest meet the others in a join whose condition is the likeness itself,
    so that it makes links alone, however many texts of a family are nearly alike; a pair that shares several bands is
    looked at in the first of them. Only rows that face another, see :func:`_facing`, fetch their shingles. ``within`` keeps
    the pairs (u, v, any others) that are links; ``sets`` gives the
    shingles of nodes (fp).
    """
    known = _headed(nodes, _bands(F.col("sketch")), BANDS, F.lit(True), within)
    keyed = known.select("fp", "comp", "size", _bands(F.col("sketch")).alias("k")).select("k.key", "k.choice", "fp", "comp", "size")
    mixed = keyed.groupBy("key").agg(F.max_by("comp", "size").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = cut_lineage(mixed.where("lo <> hi").select("key", "main"))
    rows = cut_lineage(keyed.drop("size").join(mixed, "key"))
    a, b = _facing(rows.join(known.select("fp", "sketch"), "fp"))
    ends = cut_lineage(a.select("fp").union(b.select("fp")).distinct())
    bands = known.join(ends, "fp", "left_semi").select("fp", F.array(*[F.xxhash64(F.substring("sketch", 2 * ROWS * n + 1, 2 * ROWS)) for n in range(BANDS)]).alias("bands"))
    full = cut_lineage(bands.join(sets(ends), "fp"))
    a, b = a.join(full, "fp").alias("a"), b.join(full, "fp").alias("b")
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp"))
    for n in range(BANDS - 1):
        once = once & ((F.col("a.choice") <= n) | (F.col("a.bands")[n] != F.col("b.bands")[n]))
    sizes = ALIKE[0] * F.greatest(F.size("a.shingles"), F.size("b.shingles")) <= ALIKE[1] * F.least(F.size("a.shingles"), F.size("b.shingles"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & sizes & once & _likeness("a.shingles", "b.shingles"))
    more = cut_lineage(components(met.select(F.col("a.comp").alias("u"), F.col("b.comp").alias("v"))))
    return known.join(more, known.comp == more.node, "left").select("fp", F.coalesce("root", "comp").alias("root"))


def _classes(marked: DataFrame, ids: DataFrame, roots: DataFrame) -> DataFrame:
    """Fingerprinted rows (doc_id, fp, any others) with component_id and n_class, by the components of their fingerprints (fp, first, rows)."""
    named = cut_lineage(ids.join(roots, "fp"))
    totals = cut_lineage(named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("n_class")))
    classes = cut_lineage(named.join(totals, "root").select("fp", "component_id", "n_class"))
    hidden = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return marked.join(classes, "fp", "left").select(*marked.columns, hidden("component_id"), hidden("n_class"))


def _ids(marked: DataFrame) -> DataFrame:
    return cut_lineage(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("rows")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_class) for every row of ``docs`` (doc_id, text, any others).

    fingerprint: 16 hex digits. component_id: smallest doc_id that links of ``radius`` bits or fewer reach; n_class: rows
    of the component. Null and empty texts have fingerprint 0 and link like others. Repeated rows stay repeated. Rows
    with a null doc_id keep their fingerprint, link nothing and get null in the other columns. Columns other than doc_id
    and text are not read. ``blocks`` must exceed ``radius``; more blocks mean more, smaller buckets (8 for 10^9 rows).
    """
    spark = docs.sparkSession
    marked = cut_lineage(fingerprints(docs, width))
    ids = _ids(marked)
    roots = distilled(spark, lambda: links(ids.select("fp"), radius, block_masks(radius, blocks)))
    known = _classes(marked, ids, roots)
    return known.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class")


def alike_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_mark, component_id, n_class): rows whose texts share four in five of their five-word shingles, and theirs in turn.

    text_mark is the XXH64 of the text, as Spark's ``xxhash64`` gives it. Texts that agree in a band of their sketches are candidates; sketches that are far apart rule pairs out, and the
    shingles themselves settle the others. Null and empty texts are alike; nulls and repeated rows are treated as in
    :func:`near_duplicates`.
    """
    return _alike(docs, cut_lineage(sketches(docs)).drop("print"))


def _alike(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """:func:`alike_documents` among the rows ``marked`` (doc_id, text_mark, fp, sketch) of ``docs``."""
    nodes = cut_lineage(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("rows"), F.any_value("sketch").alias("sketch")))

    def sets(ends: DataFrame) -> DataFrame:
        return shingle_table(docs, cut_lineage(nodes.select("fp", "first").join(ends, "fp")))

    def within(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(alike(cut_lineage(pairs.distinct()), nodes))
        ends = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()
        return settled(pairs, cut_lineage(sets(ends)))

    roots = cut_lineage(_alike_roots(nodes.select("fp", "sketch"), within, sets))
    return _classes(marked.drop("sketch"), nodes.drop("sketch"), roots).drop("fp")


def _linked(marked: DataFrame) -> DataFrame:
    """(doc_id, text_mark, component_id, n_class) of rows ``marked`` (doc_id, text_mark, print): the classes of :func:`near_duplicates`."""
    prints = marked.select("doc_id", "text_mark", F.col("print").alias("fp"))
    ids = _ids(prints)
    roots = distilled(marked.sparkSession, lambda: links(ids.select("fp")))
    return _classes(prints, ids, roots).drop("fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, first by fingerprints, then by shingles.

    The classes are those of :func:`near_duplicates`, found through the table of distances to reference fingerprints; their
    first documents are then compared as :func:`alike_documents` does. Rows that repeat a kept doc_id and its text are
    kept once; a different text under the same doc_id is judged by itself. Rows with a null doc_id stay. Columns keep
    their names, whatever these are.
    """
    spark = docs.sparkSession
    known = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs.doc_id.cast("bigint").alias("key"), F.xxhash64(F.coalesce(docs.text, F.lit(""))).alias("mark"))
    first = lambda classes: classes.where("doc_id = component_id").select("doc_id", "text_mark").distinct()

    def chosen() -> DataFrame:
        marked = cut_lineage(sketches(docs))
        heads = distilled(spark, lambda: first(_linked(marked)))
        return first(_alike(docs, marked.drop("print").join(heads, ["doc_id", "text_mark"], "left_semi")))

    kept = distilled(spark, chosen)
    rows = known.join(kept, (F.col("key") == kept.doc_id) & (F.col("mark") == kept.text_mark), "left_semi").dropDuplicates(["key", "mark"])
    return rows.select("row.*").unionByName(known.where("key IS NULL").select("row.*"))


def op1_simhash_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))


QUERIES = {"op1_simhash_pivots": (op1_simhash_pivots, None)}
