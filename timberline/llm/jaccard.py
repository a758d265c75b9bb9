"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

A document's set holds its distinct five-word shingles as 64-bit hashes. Equal sets form one class,
so that copies cost one row. Two classes link when 100 * intersection >= 75 * union. The product of
the incidence matrix with itself is never formed whole:

* Columns are ordered by hash, common ones last and very common ones after these. A class of n shingles can only
  link with one that shares one of its first n - ceil(0.75 n) + 1 columns, so only these entries are multiplied,
  and of them only the columns that two documents have. Both kinds of columns are found by distributed
  counts, the common ones in a first pass by hash alone, and kept in bit tables of fixed size. Any
  table gives right results; a full one only lets more entries through.
* Columns of at most ``COLD`` classes give all their pairs. Overlap counts are accumulated over the
  columns, and a pair is discarded if what they have in common, all hot columns of either and the
  rest of the larger set can't reach 3/7 of the sum of both sizes, or if the sizes are too unequal.
* Hot columns go through rounds. In each, every member outside the column's largest component is compared with
  ``LEADERS`` members of that component, others in each round; what links joins it and leaves. A group of near copies of
  which any two link with a fair chance is so joined by a few comparisons a member. A column stays as long as
  a round joins at least a fifth of its outside members.
* Members that are still outside after that are paired with all members of other components, so that no link between
  components is lost. Only shingles that members of several components have count for such a link: a class in which
  they are less than three quarters has none. Pairs are made once, in the first column that both are in, where both
  stand early enough in it, and where sketches of these shingles, parities of 512 hash buckets, differ in no more bits
  than those of linked sets may.
* Pairs that are left are verified on the whole sets, which are read from the texts once.

Components need no pair whose ends are joined already, so links within a component are not all
listed. The result is exact but for equal 64-bit hashes of different shingles.

Defined cases: null, empty or blank texts have an empty set and are their own component; a text of
one to four words is one shingle of all its words; rows that share an id are separate texts with
one id; a null id never names a component unless all ids of it are null; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import dealt_join, free_worker, salted_join
from timberline.llm.components import connected_components
from timberline.session import discard, materialize

WORDS = 5
TABLE_BITS = 26
COLD = 8
# classes of a column from which on it is very common, in units of COLD
VERY = 16
LEADERS = 4
# a column leaves the rounds when this share of its outside members is left by one
SHRINK = 0.8
# words of a sketch
SKETCH = 8
# shingles of which a task makes distinct ones at a time
TOGETHER = 1 << 19
# pairs of one class that are verified in one task
PAIRS_OF_ONE = 4096

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _chain(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    h = _mix(first + _U(len(more) + 1))
    for w in more:
        h = _mix(h * _U(0xD6E8FEB86659FD93) + w)
    return h


_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, kept by the worker."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words of the texts are hashed at once."""
    data = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    buffer = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    if not len(buffer):
        return []
    power, inverse = _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, _U)
    np.cumsum((buffer + _U(1)) * power, out=sums[1:])
    solid = np.concatenate([[False], ~_IS_SPACE[buffer], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, stop = edge[::2], edge[1::2]
    word = _mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(_U) * _U(0xA0761D6478BD642F))
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    count = max(0, len(word) - words + 1)
    every = _chain(*(word[i : i + count] for i in range(words)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        else:
            out.append(_chain(*(word[i : i + 1] for i in range(a, b))) if b > a else np.zeros(0, _U))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """``SKETCH`` words of 64 bits; a bit is set if an odd number of shingles falls on it.

    Sets differ in at least as many shingles as their sketches in bits.
    """
    odd = np.bincount((_mix(own) >> _U(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_hash(own: np.ndarray) -> int:
    """A hash of the set, signed."""
    return int(_mix(own ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U).astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of about 256,000 characters at a time, one text at least."""
    for batch in batches:
        at, size = 0, 0
        texts = batch.column(1)
        for i in range(batch.num_rows):
            size += len(texts[i].as_py() or "")
            if size >= limit or i == batch.num_rows - 1:
                yield batch.column(0)[at : i + 1], texts[at : i + 1].to_pylist()
                at, size = i + 1, 0


def _scan(docs: DataFrame, schema: str, make: Callable) -> DataFrame:
    """Rows that ``make(ids, sets)`` gives for blocks of documents; it may be a generator's factory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for ids, texts in _blocks(batches):
            yield make(ids, shingle_sets(texts))
        # the worker lives on, and others need the memory
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def _prefix(own: np.ndarray, common: list[np.ndarray], bits: int) -> np.ndarray:
    """The first shingles, of which two linked sets share one: by hash, those in more of the ``common`` tables later."""
    first = len(own) - (3 * len(own) + 3) // 4 + 1
    if not common or not len(own):
        return own[:first]
    late = sum(_in_table(own, table, bits).astype(np.int8) for table in common)
    rare = own[late == 0]
    if len(rare) >= first:
        return rare[:first]
    return own[np.argsort(late, kind="stable")[:first]]


def _table(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit table of the column's low bits; at most 2 ^ (bits - 6) words come to the driver."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def _in_table(x: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    at = (x.view(np.int64) if x.dtype == _U else x) & ((1 << bits) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _needed(a: str, b: str):
    """Least overlap of sets of these sizes that link: 100 i >= 75 (a + b - i)."""
    return F.ceil((F.col(a) + F.col(b)) * 3 / 7)


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * 4 >= F.greatest(a, b) * 3


_WORDS = [f"w{i}" for i in range(SKETCH)]


def _may_link(m: str, n: str, left: str, right: str, sketched: Column | None = None) -> Column:
    """Whether the sizes fit and the sketches, whose words have these prefixes, differ in few enough bits.

    ``sketched`` is how many shingles the sketches of both are made of, if not of all.
    """
    apart = reduce(Column.__add__, [F.bit_count(F.col(left + w).bitwiseXOR(F.col(right + w))) for w in _WORDS])
    every = F.col(m) + F.col(n) if sketched is None else sketched
    return _sizes_fit(m, n) & (apart <= every - 2 * _needed(m, n))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a class in very many pairs is dealt over several tasks; only its own set is copied
    busy = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_OF_ONE).alias("_parts")).where(F.col("_parts") > 1)
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    dealt = pairs.join(busy, "a", "left").withColumn("_part", F.pmod(F.xxhash64("b"), parts)).drop("_parts")
    copied = sets.select(F.col("class").alias("a"), F.col("own").alias("x")).join(busy, "a", "left")
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    with_b = dealt.join(sets.select(F.col("class").alias("b"), F.col("own").alias("y")), "b")
    # the copies are more than Spark takes them for, so they don't go to every task
    return with_b.join(copied.hint("merge"), ["a", "_part"]).select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bits: int = TABLE_BITS, cold: int = COLD
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): ids are the smallest of the same set and of all linked."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()

    context = docs.sparkSession.sparkContext

    def heights_of(common: Broadcast) -> DataFrame:
        """(key, docs) of the first columns that several documents have."""

        def columns(ids, sets):
            found = [_prefix(s, common.value, table_bits) for s in sets]
            return pa.RecordBatch.from_arrays([_long(np.concatenate(found))], ["key"])

        return _scan(own, "key bigint", columns).groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") > 1)

    tall = materialize(heights_of(context.broadcast([])).where(F.col("docs") > cold), "tall")
    common = context.broadcast([_table(tall.where(F.col("docs") > least), "key", table_bits) for least in (cold, cold * VERY)])
    discard(tall)
    shared = context.broadcast(_table(heights_of(common), "key", table_bits))

    def described(ids, sets):
        """A row without key for each document, and one without id for each entry of the product."""
        found = [_prefix(s, common.value, table_bits) for s in sets]
        kept = [_in_table(x, shared.value, table_bits) for x in found]
        places = [np.flatnonzero(k) for k in kept]
        found = [x[k] for x, k in zip(found, kept, strict=True)]
        classes, lengths = np.array([class_hash(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int64)
        sizes = [len(x) for x in found]
        entries = sum(sizes)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids, pa.nulls(entries, ids.type)]),
                pa.concat_arrays([pa.nulls(len(sets), pa.int64()), _long(np.concatenate(found))]),
                pa.array(np.concatenate([classes, np.repeat(classes, sizes)])),
                pa.array(np.concatenate([lengths, np.repeat(lengths, sizes)])),
                pa.concat_arrays([pa.nulls(len(sets), pa.int32()), pa.array(np.concatenate(places).astype(np.int32))]),
            ],
            ["doc_id", "key", "class", "n", "place"],
        )

    described_rows = materialize(_scan(own, f"doc_id {id_type}, key bigint, class bigint, n bigint, place int", described), "described")
    # tables that tasks have no more use for leave the executors
    common.unpersist()
    shared.unpersist()
    info = materialize(described_rows.where("key is null").select("doc_id", "class", "n"), "info")
    incidence = materialize(described_rows.where("key is not null").select("key", "class", "n", "place").distinct(), "incidence")
    heights = incidence.groupBy("key").agg(F.count("*").alias("height")).where(F.col("height") > 1)
    discard(described_rows)
    shared_entries = materialize(salted_join(incidence, heights, ["key"], ["class"], salts=4), "shared")
    discard(incidence)
    few = shared_entries.where(F.col("height") <= cold)
    many = shared_entries.where(F.col("height") > cold)
    pairs = few.select("key", F.col("class").alias("a"), F.col("n").alias("m")).join(
        few.select("key", F.col("class").alias("b"), "n"), "key"
    ).where((F.col("a") < F.col("b")) & _sizes_fit("m", "n"))
    counted = pairs.groupBy("a", "b", "m", "n").agg(F.count("*").alias("common"))
    candidates = _within_reach(counted, many.groupBy("class").agg(F.count("*").alias("other")))
    candidates = materialize(candidates, "pairs")
    many = materialize(many, "many")
    discard(shared_entries)
    return _joined(own, info, candidates, many, table_bits, id_type)


def _reachable(common):
    """Whether an overlap of ``common`` first columns can still grow to what sizes m and n need.

    Of a set of size n, ceil(0.75 n) - 1 shingles lie outside its first columns.
    """
    return common + F.ceil(F.greatest("m", "n") * 3 / 4) - 1 >= _needed("m", "n")


def _within_reach(counted: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ``common`` columns and all ``other`` ones of either side may be enough."""
    for side in ("a", "b"):
        own = other.select(F.col("class").alias(side), F.col("other").alias(f"other_{side}"))
        counted = counted.join(own, side, "left")
    more = F.least(F.coalesce("other_a", F.lit(0)), F.coalesce("other_b", F.lit(0)))
    return counted.where(_reachable(F.col("common") + more)).select("a", "b")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("node").alias("class"), "label")
    return entries.join(own, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after the components that ``links`` connect are one."""
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    ends = ends.select(*[F.coalesce(f"label_{side}", side).alias(side) for side in ("a", "b")]).where("a <> b").distinct()
    moved = connected_components(ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    nodes = materialize(labels.unionByName(fresh.withColumn("label", F.col("node"))), "nodes")
    joined = dealt_join(nodes, moved, ["label"], ["node"], "left")
    newer = materialize(joined.select("node", F.coalesce("to", "label").alias("label")), "labels")
    discard(labels, nodes)
    return newer


def _splits(own: DataFrame) -> DataFrame:
    """(key, top, outside) of the columns with several components: the largest, and how many members are in others."""
    sizes = own.groupBy("key", "label").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"))
    return tops.where(F.col("total") > F.col("top.n")).select("key", F.col("top.label").alias("top"), (F.col("total") - F.col("top.n")).alias("outside"))


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, m, n) whose sketches leave a link possible."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("class").alias(side), *[F.col(w).alias(f"{side}_{w}") for w in _WORDS]), side)
    return pairs.where(_may_link("m", "n", "a_", "b_")).select("a", "b")


def _leader_rounds(many: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The labels after rounds of comparing what is outside a column's largest component with members of it."""
    before, number = None, 0
    while True:
        own = materialize(_labelled(many, labels), "labelled")
        splits = _splits(own)
        if before is not None:
            shrunk = F.col("outside") <= F.col("earlier") * SHRINK
            splits = splits.join(before.select("key", F.col("outside").alias("earlier")), "key").where(shrunk).drop("earlier")
        splits = materialize(splits, "splits")
        members = salted_join(own, splits.select("key", "top"), ["key"], ["class"])
        order = F.xxhash64("class", F.lit(number))
        leaders = (
            members.where("label = top").groupBy("key", F.pmod(order, F.lit(LEADERS)).alias("lane"))
            .agg(F.min(F.struct(order.alias("order"), "class", "n")).alias("led"))
            .select("key", F.col("led.class").alias("a"), F.col("led.n").alias("m"))
        )
        pairs = salted_join(members.where("label <> top"), leaders, ["key"], ["class"]).where(_sizes_fit("m", "n"))
        pairs = materialize(_sketched(pairs.select("a", F.col("class").alias("b"), "m", "n").distinct(), sets), "pairs")
        links = materialize(_verified(pairs, sets), "verified")
        found = not links.isEmpty()
        if found:
            labels = _relabelled(labels, links)
        discard(own, pairs, links, *([] if before is None else [before]))
        before, number = splits, number + 1
        if not found:
            discard(splits)
            return labels


def _ends(sets: list[np.ndarray], labels: list[int]) -> pa.RecordBatch:
    """(shingle, low, high): the distinct shingles of the sets, each with the smallest and the largest label of a set that has it."""
    shingle, label = np.concatenate(sets), np.repeat(np.array(labels, np.int64), [len(x) for x in sets])
    order = np.lexsort((label, shingle))
    shingle, label = shingle[order], label[order]
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    last = np.append(new[1:], True)[: len(new)]
    return pa.RecordBatch.from_arrays([_long(shingle[new]), pa.array(label[new]), pa.array(label[last])], ["shingle", "low", "high"])


def _foreign(own: DataFrame, sets: DataFrame, table_bits: int) -> DataFrame:
    """(class, e, words) of the entries' classes that a link to another component is possible for.

    What a class may share with other components are its ``e`` shingles that members of several components have;
    the words sketch these. The other ones are in no such overlap, so a class of which they are more than a quarter goes.
    Classes with the same first column lie together, so that a task has most of a passage's holders and makes one row of
    each of its shingles.
    """
    labels = own.groupBy("class", "label").agg(F.min_by("key", "place").alias("near"))
    held = labels.join(sets.select("class", "own"), "class").repartitionByRange("near", "class")
    held = materialize(held.select("class", "label", "own"), "held")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, label, size = [], [], 0
        for batch in batches:
            for own_label, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found.append(np.frombuffer(x.as_buffer(), _U))
                label.append(own_label)
                size += len(found[-1])
                if size >= TOGETHER:
                    yield _ends(found, label)
                    found, label, size = [], [], 0
        if found:
            yield _ends(found, label)

    ends = held.mapInArrow(entries, "shingle bigint, low bigint, high bigint")
    ends = ends.groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    table = own.sparkSession.sparkContext.broadcast(_table(ends.where("low <> high"), "shingle", table_bits))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.frombuffer(x.as_buffer(), _U) for x in batch.column(2)]
            found = [x[_in_table(x, table.value, table_bits)] for x in whole]
            keep = np.array([4 * len(x) >= 3 * len(y) for x, y in zip(found, whole, strict=True)], bool)
            words = np.array([sketch(x) for x, k in zip(found, keep, strict=True) if k], np.int64).reshape(-1, SKETCH)
            sizes = np.array([len(x) for x in found], np.int64)[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(sizes), *map(pa.array, words.T)], ["class", "e", *_WORDS])

    left = materialize(held.mapInArrow(described, "class bigint, e bigint, " + ", ".join(f"{w} bigint" for w in _WORDS)), "foreign")
    table.unpersist()
    discard(held)
    return left


def _residual(many: DataFrame, labels: DataFrame, sets: DataFrame, table_bits: int = TABLE_BITS) -> DataFrame:
    """Pairs of members of a hot column that are in different components, if they may link.

    The first column that a linked pair shares stands early in both: behind it both sets have at least as many
    shingles as the pair must share, but for itself. A pair is made in the first of the columns that both are in.
    """
    every = materialize(_labelled(many, labels), "labelled")
    split = materialize(salted_join(every, _splits(every).select("key"), ["key"], ["class"]), "split")
    left = _foreign(split, sets, table_bits)
    own = split.join(left, "class")
    own = own_rows = materialize(salted_join(own, _splits(own).select("key", "top"), ["key"], ["class"]), "members")
    keys = own.groupBy("class").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))
    own = own.join(keys, "class")

    def side(rows: DataFrame, name: str, size: str, *more: str) -> DataFrame:
        words = [F.col(w).alias(f"{name}_{w}") for w in _WORDS]
        return rows.select(
            "key", F.col("class").alias(name), F.col("n").alias(size),
            *[F.col(c).alias(f"{name}_{c}") for c in ("place", "label", "e", "keys")], *words, *more
        )

    first = side(own.where("label <> top"), "a", "m")
    other = side(own, "b", "n", "top")
    early = (F.col("m") - F.col("a_place") >= _needed("m", "n")) & (F.col("n") - F.col("b_place") >= _needed("m", "n"))
    apart = (F.col("a_label") != F.col("b_label")) & ((F.col("b_label") == F.col("top")) | (F.col("a") < F.col("b")))
    before = F.slice("a_keys", F.lit(1), (F.array_position("a_keys", F.col("key")) - 1).cast("int"))
    pairs = first.join(other, "key").where(
        apart & early & _may_link("m", "n", "a_", "b_", F.col("a_e") + F.col("b_e")) & ~F.arrays_overlap(before, "b_keys")
    )
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    discard(every, split, left, own_rows)
    return pairs


def _whole_sets(own: DataFrame, info: DataFrame, classes: DataFrame, table_bits: int, id_type: str) -> DataFrame:
    """(class, own) of the classes: the whole sets, from one carrier document of each."""
    wanted = materialize(classes.distinct(), "wanted")
    carriers = salted_join(info, wanted, ["class"], ["doc_id"]).groupBy("class").agg(F.min("doc_id").alias("carrier"))
    table = own.sparkSession.sparkContext.broadcast(_table(wanted, "class", table_bits))

    def whole(ids, sets):
        hashes = np.array([class_hash(s) for s in sets], np.int64)
        keep = _in_table(hashes, table.value, table_bits)
        kept = [s for s, k in zip(sets, keep, strict=True) if k]
        words = np.array([sketch(s) for s in kept], np.int64).reshape(-1, SKETCH)
        columns = [ids.filter(pa.array(keep)), pa.array(hashes[keep]), pa.array([s.tobytes() for s in kept], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, words.T)], ["doc_id", "class", "own", *_WORDS])

    found = _scan(own, f"doc_id {id_type}, class bigint, own binary, " + ", ".join(f"{w} bigint" for w in _WORDS), whole)
    sets = materialize(
        found.join(carriers, (found["doc_id"].eqNullSafe(carriers["carrier"])) & (found["class"] == carriers["class"]))
        .select(found["class"], "own", *_WORDS).dropDuplicates(["class"]),
        "sets",
    )
    table.unpersist()
    discard(wanted)
    return sets


def _joined(
    own: DataFrame, info: DataFrame, candidates: DataFrame, many: DataFrame, table_bits: int, id_type: str
) -> DataFrame:
    classes = candidates.select(F.explode(F.array("a", "b")).alias("class")).unionAll(many.select("class"))
    sets = _whole_sets(own, info, classes, table_bits, id_type)
    links = materialize(_verified(candidates, sets), "verified")
    labels = connected_components(links)
    discard(candidates, links)
    labels = _leader_rounds(many, labels, sets)
    pairs = _residual(many, labels, sets, table_bits)
    links = materialize(_verified(pairs, sets), "verified")
    if not links.isEmpty():
        labels = _relabelled(labels, links)
    discard(pairs, links, many, sets)
    groups = salted_join(info, labels.select(F.col("node").alias("class"), "label"), ["class"], ["doc_id"], "left")
    groups = groups.withColumn("label", F.coalesce("label", "class"))
    by_class = groups.groupBy("class", "label").agg(F.min("doc_id").alias("class_id"))
    by_label = by_class.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = by_class.join(by_label, "label").select("class", "class_id", "component_id")
    empty = F.col("n") == 0
    return salted_join(info, named, ["class"], ["doc_id"]).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
