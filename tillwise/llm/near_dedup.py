"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gets a signature of ``SYMBOLS`` values of ``b`` bits, one per
hash function. Two signatures that differ in at most ``RADIUS`` symbols have, by the pigeonhole
principle, a chunk of the ``CHUNKS`` in which they differ in one symbol at most. All ways to leave
one symbol out of a chunk are enumerated as keys, so such a pair shares a key for certain.
A pair of similarity 0.8 differs in more symbols with a chance of 3.6e-6, but is missed only if it
differs in two or more in each of the chunks: 16 have five symbols and 8 six, so the chance
is 0.263^16 x 0.345^8, or 1e-13, for independent hashes. Pairs that have met are not judged by
their signatures: what bitmaps of the sets allow is confirmed, as every link is, on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import free_name
from .components import components
from .stored import store
from .texts import separators, shingle_hashes, slices, text_rows, utf8, word_hashes

SHINGLE = 4
PERCENT = 80
SYMBOLS = 128
CHUNKS = 24
RADIUS = 2 * CHUNKS - 1
BLOCK = 1024
HUB_VOTES = 64
BITS = 1024
PAIR_KINDS = "a bigint, b bigint"
HUB_KINDS = PAIR_KINDS + ", key bigint, slot smallint, blocks int"
_COUNTS = np.array([bin(byte).count("1") for byte in range(256)], dtype=np.int64)

WHITE = separators(b" \t\n\x0b\x0c\r")
_random = np.random.default_rng(11)
_FACTORS = _random.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_ADDED = _random.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_BOUNDS = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each whole text, ascending. Fewer words than a shingle
    has make one of all of them; no words, none."""
    data, bounds = utf8(texts)
    words, first = word_hashes(data, bounds, WHITE)
    shingles = shingle_hashes(words, size)
    sets = []
    for start, stop in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = stop - start
        if n >= size:
            sets.append(np.unique(shingles[start : stop - size + 1]))
        else:
            whole = shingle_hashes(words[start:stop], n) + np.uint64(n) if n else words[:0]
            sets.append(whole)
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of each hash function over a set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(short), 2048):
        values = short[i : i + 2048, None] * _FACTORS + _ADDED
        np.minimum(least, values.min(axis=0), out=least)
    # The bits are taken after a mix, as the least of many values are all small.
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((least ^ (least >> np.uint32(12))) & np.uint32(0xFFFF)).astype(np.uint16)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each value of a shingle's low bits. A bit that one set has and another lacks is a
    shingle that the other lacks, so bitmaps bound what two sets can share."""
    bits = np.zeros(BITS, dtype=bool)
    bits[shingles & np.uint64(BITS - 1)] = True
    return np.packbits(bits).tobytes()


def class_of(shingles: np.ndarray) -> int:
    """A number that texts with equal sets share."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Per signature, a key for every chunk and symbol left out of it."""
    out = []
    for chunk, (start, stop) in enumerate(zip(_BOUNDS[:-1], _BOUNDS[1:], strict=True)):
        for left_out in range(start, stop):
            kept = [i for i in range(start, stop) if i != left_out]
            tag = np.uint64(1 + left_out + (chunk << 16))
            out.append(shingle_hashes(_tagged(signatures, kept, tag).ravel(), len(kept) + 1)[:: len(kept) + 1])
    return np.stack(out, axis=1).view(np.int64) if len(signatures) else np.zeros((0, SYMBOLS), np.int64)


def _tagged(signatures: np.ndarray, kept: list[int], tag: np.uint64) -> np.ndarray:
    rows = np.empty((len(signatures), len(kept) + 1), dtype=np.uint64)
    rows[:, 0], rows[:, 1:] = tag, signatures[:, kept]
    return rows


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``n_shingles``, ``class`` and ``signature`` of
    every document; those without words have no class and no signature."""
    own = docs["doc_id"].cast("bigint").alias("doc_id")
    rows = docs.select(own, F.xxhash64(docs["text"]).alias("text_key"), docs["text"])
    rows = text_rows(rows, "doc_id", "text_key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                sets = shingle_sets(batch.column(2)[start:stop], size)
                columns = [
                    batch.column(0)[start:stop],
                    batch.column(1)[start:stop],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    kinds = {"doc_id": "bigint", "text_key": "bigint", "n_shingles": "bigint"}
    kinds |= {"class": "bigint", "signature": "binary", "bits": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def _keys(classes: DataFrame) -> DataFrame:
    """``key``, ``class`` and ``slot``, the symbol left out, for all keys of all classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                held = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16)
                keys = chunk_keys(held.reshape(-1, SYMBOLS))
                owners = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                slots = np.tile(np.arange(SYMBOLS, dtype=np.int16), len(keys))
                columns = [pa.array(keys.ravel()), pa.array(owners), pa.array(slots)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "class", "slot"])

    kinds = "key bigint, class bigint, slot smallint"
    # A class makes SYMBOLS rows, so the small table of classes is dealt to as many tasks as a
    # shuffle has; a task's keys are summed up in little memory then.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.select("class", "signature").repartition(parts, "class")
    return spread.mapInArrow(run, kinds)


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Those pairs whose full sets are similar enough.

    The sets of the texts that occur in pairs are made anew from one document of each class. A
    pair's larger group member comes to the other's set: rows of one ``a`` lie together in
    groups of bounded size, its own set first, so each set of a ``b`` moves once per link.
    """
    spread = F.pmod(F.xxhash64("b"), F.lit(64))
    grouped = pairs.withColumn("part", spread)
    firsts = grouped.select("a", "part").distinct()
    wanted = firsts.select(F.col("a").alias("class"), "a", "part", F.lit(0).alias("role")).union(
        grouped.select(F.col("b").alias("class"), "a", "part", F.lit(1))
    )
    needed = wanted.select("class").distinct().join(classes.select("class", "doc_id"), "class")
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    ids = needed.select(F.col("doc_id").alias("id")).distinct()
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                sets = [s for s in shingle_sets(batch.column(0)[start:stop], size) if len(s)]
                columns = [
                    pa.array([class_of(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "shingles"])

    # Rows that share an id may have other texts, and a null id none: any text of the class will do.
    sets = text_rows(texts).mapInArrow(make, "class bigint, shingles binary")
    sets = sets.groupBy("class").agg(F.first("shingles").alias("shingles"))
    laid = wanted.join(sets, "class").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            names = ("class", "a", "part", "role", "shingles")
            cells = [batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names]
            found = []
            for held, a, part, role, shingles in zip(*cells, strict=True):
                values = np.frombuffer(shingles, np.uint64)
                if role == 0:
                    group, own = (a, part), values
                elif group == (a, part):
                    shared = len(np.intersect1d(own, values, assume_unique=True))
                    if 100 * shared >= PERCENT * (len(own) + len(values) - shared):
                        found.append((a, held))
            ends = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(end, pa.int64()) for end in ends], names=["a", "b"]
            )

    return laid.mapInArrow(check, "a bigint, b bigint")


def _hubs(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """In each block of a key, the class most like the others, paired with those within ``RADIUS`` of it.

    Copies of one text differ more from one another than from it, so these few pairs connect
    most of a family before any others are compared. The blocks of a key send their hubs to a next
    level, until the key is one block: a class makes one row per key, whatever the number of blocks.
    """
    level = keyed.withColumn("root", F.col("class"))
    pairs: DataFrame | None = None
    while True:
        meets = F.lit(None).cast("int")
        laid = level.withColumns({"block": _block(F.col("blocks")), "meets": meets})
        found = store(_in_cells(laid, classes, _around_hub, HUB_KINDS), "block-hubs")
        near = found.where("key is null").select("a", "b")
        pairs = near if pairs is None else pairs.union(near)
        hubs = found.where("key is not null")
        if hubs.isEmpty():
            return pairs.distinct()
        # A key of one block has no hub row, so its hubs have met all that they have to.
        level = hubs.select(
            "key", F.col("a").alias("class"), "slot",
            F.ceil(F.col("blocks") / BLOCK).cast("int").alias("blocks"), F.col("a").alias("root"),
        )


def _block(blocks: Column) -> Column:
    """The block of a class among those of a key."""
    return F.pmod(F.xxhash64("class"), blocks).cast("int")


def _across(keyed: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that share a key but are not connected yet, each once: a pair
    leaves only the cell of the first key that both have, and only if sizes and bitmaps allow the
    similarity. Keys whose classes are all connected are left out.

    The classes of a key's largest root are not compared with one another. They make the last
    blocks and meet only the first ones, those of all other classes.
    """
    ends = roots.withColumnRenamed("node", "class")
    placed = keyed.drop("blocks").join(ends, "class", "left").withColumn("root", F.coalesce("root", "class"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    sides = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        F.max("n").alias("n_main"),
        F.sum("n").alias("n"),
    )
    firsts = F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int").alias("firsts")
    lasts = F.ceil(F.col("n_main") / BLOCK).cast("int").alias("lasts")
    mixed = sides.where("n > n_main").select("key", "main", firsts, lasts)
    met = placed.join(mixed, "key")
    is_main = F.col("root") == F.col("main")
    block = F.when(is_main, F.col("firsts") + _block(F.col("lasts"))).otherwise(_block(F.col("firsts")))
    meets = F.when(is_main, F.col("firsts")).otherwise(F.col("firsts") + F.col("lasts"))
    laid = met.withColumns({"block": block, "meets": meets, "blocks": F.col("firsts") + F.col("lasts")})
    return _in_cells(laid, classes, _apart, PAIR_KINDS, ["n_shingles", "bits"])


def _in_cells(
    keyed: DataFrame,
    classes: DataFrame,
    compare: Callable[[list[tuple], tuple | None], Iterator[pa.RecordBatch]],
    kinds: str,
    more: Sequence[str] = (),
) -> DataFrame:
    """What ``compare`` finds in each cell, the meeting of two blocks of a key.

    ``keyed`` has a row for each class and shared key, with the class's root, the number of
    ``blocks`` of the key, the class's ``block`` and the number of blocks that this ``meets``, from
    the first; null: only itself. A class's keys, root and signature come together in one row; from
    there it goes to its cells. So a key that very many classes share is spread over many tasks.
    """
    own = F.struct("key", "slot", "blocks", "block", "meets")
    by_class = keyed.groupBy("class", "root").agg(F.collect_list(own).alias("keys"))
    by_class = by_class.join(classes.select("class", "signature", *more), "class")
    each = by_class.select("class", "root", "signature", *more, F.inline("keys"))
    numbers = F.when(F.col("meets").isNull(), F.array("block")).otherwise(
        F.sequence(F.lit(0), F.col("meets") - 1)
    )
    cells = F.transform(
        numbers, lambda i: F.struct(F.least(i, "block").alias("x"), F.greatest(i, "block").alias("y"))
    )
    laid = each.select(
        "key", "slot", "blocks", F.inline(cells), "block", "class", "root", "signature", *more
    )
    laid = laid.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "class")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cell = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, slot, blocks, x, y, *row in zip(*columns, strict=True):
                if (key, x, y, slot, blocks) != cell:
                    yield from compare(held, cell)
                    cell, held = (key, x, y, slot, blocks), []
                held.append(row)
        yield from compare(held, cell)

    return laid.mapInArrow(run, kinds)


def _around_hub(held: list[tuple], cell: tuple | None) -> Iterator[pa.RecordBatch]:
    """The hub of one block's rows, by its likeness to some of them, with what is near it; a row
    with the key says what the hub is, if the key has other blocks."""
    if cell is None or (len(held) < 2 and cell[4] == 1):
        return
    names = np.array([row[1] for row in held])
    signs = np.frombuffer(b"".join(row[3] for row in held), np.uint16).reshape(-1, SYMBOLS)
    alike = np.zeros(len(held), dtype=np.int64)
    for some in signs[:: max(1, len(held) // HUB_VOTES)]:
        alike += (signs == some).sum(axis=1)
    hub = int(alike.argmax())
    near = np.flatnonzero((signs != signs[hub]).sum(axis=1) <= RADIUS)
    near = near[near != hub]
    key, _, _, slot, blocks = cell
    told = [int(names[hub])] if blocks > 1 else []
    none = [None] * len(near)
    columns = [
        pa.array(np.minimum(names[near], names[hub]).tolist() + told, pa.int64()),
        pa.array(np.maximum(names[near], names[hub]).tolist() + told, pa.int64()),
        pa.array(none + [key for _ in told], pa.int64()),
        pa.array(none + [slot for _ in told], pa.int16()),
        pa.array(none + [blocks for _ in told], pa.int32()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "slot", "blocks"])


def _apart(held: list[tuple], cell: tuple | None) -> Iterator[pa.RecordBatch]:
    """Possible pairs with different roots among one cell's rows that share no earlier key."""
    if len({row[2] for row in held}) < 2:
        return
    _, x, y, slot, _ = cell
    block, names, roots, sizes = (np.array([row[i] for row in held]) for i in (0, 1, 2, 4))
    bits = np.frombuffer(b"".join(row[5] for row in held), np.uint8).reshape(len(held), -1)
    signs = np.frombuffer(b"".join(row[3] for row in held), np.uint16).reshape(-1, SYMBOLS)
    one, other = np.flatnonzero(block == x), np.flatnonzero(block == y)
    a, b = [], []
    for i in one:
        rest = other[other > i] if x == y else other
        rest = rest[roots[rest] != roots[i]]
        near = _first_slot(signs[rest] != signs[i]) == slot
        near[near] = _may_be_similar(sizes[i], bits[i], sizes[rest[near]], bits[rest[near]])
        a.append(np.minimum(names[rest[near]], names[i]))
        b.append(np.maximum(names[rest[near]], names[i]))
    if a:
        columns = [pa.array(np.concatenate(side), pa.int64()) for side in (a, b)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def _may_be_similar(
    size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray
) -> np.ndarray:
    """Whether one set can be similar enough to others, by what each has that the other lacks."""
    own = size - _COUNTS[bits & ~others].sum(axis=1)
    shared = np.minimum(own, sizes - _COUNTS[others & ~bits].sum(axis=1))
    return 100 * shared >= PERCENT * (size + sizes - shared)


def _first_slot(differ: np.ndarray) -> np.ndarray:
    """The first slot whose key two signatures share, by the symbols in which they differ."""
    errors = np.add.reduceat(differ.astype(np.int16), _BOUNDS[:-1], axis=1)
    chunk = (errors < 2).argmax(axis=1)
    rows = np.arange(len(differ))
    places = np.arange(SYMBOLS)
    inside = (places >= _BOUNDS[chunk][:, None]) & (places < _BOUNDS[chunk + 1][:, None])
    wrong = (differ & inside).argmax(axis=1)
    return np.where(errors[rows, chunk] > 0, wrong, _BOUNDS[chunk])


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    A document's set is its distinct runs of ``size`` words, or the one run of all its words
    if they are fewer; documents are linked if 100 times the shared runs reach ``PERCENT`` times
    all of both. A null or empty text has no words and is linked with nothing. ``component_id`` is
    the smallest id reachable by links, and that document is the one kept. Each row has a row
    in the result; rows with the same id and text are all kept or all not. A null id is never
    a ``component_id``, but for a document linked with no other id, which is kept. Other columns
    are not read.

    Texts with equal sets are one class. Classes are first linked with the hub of each key; after
    that, what is still apart is compared with all others under its keys.
    """
    return decisions(docs, size).drop("text_key", "worded", "stays")


def decisions(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``near_duplicates`` with the ``text_key`` of each row, xxhash64 of its text."""
    each = store(signatures(docs, size), "signatures")
    with_words = each.where(F.col("class").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = with_words.groupBy("class").agg(
        F.min("doc_id").alias("doc_id"),
        F.min(order).alias("first"),
        *[F.min(name).alias(name) for name in ("n_shingles", "signature", "bits")],
    )
    classes = store(classes, "classes")
    keys = _keys(classes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    shared = store(sizes.where("size > 1").select("key", blocks), "shared-keys")
    keyed = store(keys.join(shared, "key"), "keyed")
    links = store(_confirmed(store(_hubs(keyed, classes), "hubs"), docs, classes, size), "hub-links")
    roots = components(links)
    rest = store(_across(keyed, roots, classes), "across")
    if not rest.isEmpty():
        more = _confirmed(rest, docs, classes, size)
        links = store(links.union(more), "all-links")
        roots = components(links)
    roots = roots.withColumnRenamed("node", "class")
    grouped = classes.join(roots, "class", "left").select(
        "class", "doc_id", "first", F.coalesce("root", "class").alias("root")
    )
    least = grouped.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min("first").alias("survivor")
    )
    named = grouped.join(least, "root").select("class", "component_id", "survivor")
    result = each.join(named, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    stays = F.struct("doc_id", "text_key") == F.struct("survivor.doc_id", "survivor.text_key")
    return result.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.col("class").isNotNull().alias("worded"),
        F.when(F.col("class").isNull(), True).otherwise(stays).alias("stays"),
    )


def without_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group of near duplicates, by runs of ``size`` words, with all its columns,
    whatever their names.

    It is the one with the smallest id, of several rows with that id the one whose text has the
    smallest hash, and of equal rows one; a row without an id stays only where its group has no
    id. Null and empty texts are in no group; of these, rows repeated with an id and text are one.
    """
    decided = store(decisions(docs, size), "near-duplicates")
    id_, key = (free_name(docs.columns, name) for name in ("_id", "_key"))
    named = [F.col("doc_id").alias(id_), F.col("text_key").alias(key)]

    def same(df: DataFrame) -> Column:
        return df["doc_id"].cast("bigint").eqNullSafe(F.col(id_)) & F.xxhash64(df["text"]).eqNullSafe(F.col(key))

    rest = docs.join(decided.where("not stays").select(*named).distinct(), same(docs), "left_anti")
    alike = decided.where("stays and (worded or doc_id is not null)").groupBy("doc_id", "text_key")
    again = store(alike.count().where("count > 1").select(*named), "repeated")
    if again.isEmpty():
        return rest
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    once = rest.join(again, same(rest), "left_semi")
    once = once.select(row.alias("row"), F.xxhash64("text").alias("text_key"))
    once = once.groupBy(F.col("row.doc_id"), "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rest.join(again, same(rest), "left_anti").unionByName(once.select("row.*"))
