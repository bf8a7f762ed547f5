"""Near-duplicate documents by bottom-k sketches from one hash function.

The sketch of a document holds the SKETCH smallest hash values of its shingles, so a smaller set is its own sketch.
Inverted lists of runs of retained values bring most copies together; the sketches of two neighbours in a list
estimate their similarity, and full sets confirm it. What is still apart meets in inverted lists of single retained
values, rarest first, and is compared there in blocks. Every step gives out fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.components import components
from salesflow.llm.suffix_dedup import NO_KEY
from salesflow.llm.tables import table
from salesflow.llm.textops import LOWER, gram_hash, inside, mixed, range_hash, slices, words
from salesflow.session import Scratch, materialize

WORDS = 5
SKETCH = 128
LISTED = 64             # smallest retained values whose runs are listed
# Two sets of similarity 0.85 share a run of 5 among their 64 smallest values but for 2 in a million, and surely if they
# are no larger; a set of less than 20 may only share a run of 3.
RUNS = ((5, 17, None), (3, 3, 24))
LEAST_ESTIMATE = 0.70   # nearly five standard deviations below 0.85 for 128 values
BLOCK_VALUES = 1 << 19  # hashes of the members of one list that are compared as one side of a cell

_SETS = "doc bigint, text_hash bigint, n bigint, set_id binary, sketch array<bigint>"
_LINKS = "a bigint, b bigint"
_FULL = "sid bigint, hashes array<bigint>"


def _shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes (63 bits) of every text."""
    for lo, hi, data, offsets in slices(column):
        data = LOWER[data]
        start, end, first = words(data, offsets)
        word = range_hash(data)(start, end)
        grams = gram_hash(word, WORDS) >> np.uint64(1)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= WORDS:
                yield lo + i, np.unique(grams[a:b - WORDS + 1]).astype(np.int64)
            else:
                yield lo + i, (gram_hash(word[a:b], int(b - a)) >> np.uint64(1)).astype(np.int64) if b > a else np.zeros(0, np.int64)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids, sketches = [], [], []
        for _, hashes in _shingles(batch.column(2)):
            h = hashes.view(np.uint64)
            n.append(len(h))
            ids.append(b"".join(int(x).to_bytes(8, "big") for x in (mixed(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(~h)))) if len(h) else None)
            sketches.append(hashes[:SKETCH].copy())   # a view would keep the whole set
        sizes = np.concatenate([[0], np.cumsum([len(s) for s in sketches])]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *sketches])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                               pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))], names=["doc", "text_hash", "n", "set_id", "sketch"])


def _full_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, sets, size = [], [], 0

        def given() -> pa.RecordBatch:
            bounds = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *sets])
            return pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))], names=["sid", "hashes"])

        for row, hashes in _shingles(batch.column(1)):
            rows.append(row)
            sets.append(hashes)
            size += len(hashes)
            if size >= BLOCK_VALUES:
                yield given()
                rows, sets, size = [], [], 0
        yield given()


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs with their sketches: the share of common values among those of both up to the smaller of their ends, and
    whether both sketches are whole sets, so that the share is exact."""
    for batch in batches:
        n = [np.asarray(batch.column(c)) for c in (2, 3)]
        lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in (4, 5)]
        share = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            a, b = (values[bounds[i]:bounds[i + 1]] for bounds, values in lists)
            both = len(np.intersect1d(a, b, assume_unique=True))
            end = min([s[-1] for s, size in ((a, n[0][i]), (b, n[1][i])) if size > SKETCH], default=None)
            union = len(a) + len(b) if end is None else int(np.searchsorted(a, end, "right") + np.searchsorted(b, end, "right"))
            share[i] = both / (union - both)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(share), pa.array((n[0] <= SKETCH) & (n[1] <= SKETCH))], names=["a", "b", "estimate", "whole"])


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of lists with two members or more, and of the first and last list of the partition.

    Rows come sorted by list. A list that spans partitions is the last of one and the first of the next.
    """
    held, opening, follows = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch])
        lists = rows.column(0).to_numpy()
        opening = lists[0] if opening is None else opening
        same = lists[1:] == lists[:-1]
        keep = np.append(follows, same) | np.append(same, False) | (lists == opening)
        yield from rows.slice(0, len(lists) - 1).filter(pa.array(keep[:-1])).to_batches()
        held, follows = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if held is not None:
        yield held


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that stand next to each other in a list; rows come sorted by list and size."""
    last = np.zeros((2, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([last, [np.asarray(batch.column(0)), np.asarray(batch.column(1))]], axis=1)
        at = np.flatnonzero(rows[0, 1:] == rows[0, :-1])
        a, b = rows[1, at], rows[1, at + 1]
        yield pa.record_batch([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])
        last = rows[:, -1:]


def linked_members(sets: list[np.ndarray], roots: list[int], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of members that join the components of a cell: a forest, so fewer pairs than members.

    ``sets`` are sorted hashes. Members of different components are compared, those of one side (1 or 2) only with the other
    side (0: with all). Counts of common sketch values come from one pass over all sketches per member; exact Jaccard decides
    whenever the estimate is high enough.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, roots, side = [sets[i] for i in order], [roots[i] for i in order], np.array([side[i] for i in order])
    n = np.array([len(x) for x in sets])
    sketches = [x[:SKETCH] for x in sets]
    bounds = np.append(0, np.cumsum([len(x) for x in sketches]))
    values, flat = np.unique(np.concatenate(sketches), return_inverse=True)
    ends = np.where(n > SKETCH, flat[bounds[1:] - 1], len(values))   # where a sketch ends, as a number of ``values``
    component = np.unique(np.array(roots), return_inverse=True)[1]
    present, links = np.zeros(len(values), bool), []
    for i in range(len(sets)):
        first = int(np.searchsorted(n[:i], -(-percent * n[i] // 100)))   # smaller sets that are large enough
        other = np.flatnonzero(component[first:i] != component[i]) + first
        if side[i]:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        mine = flat[bounds[i]:bounds[i + 1]]
        present[mine] = True
        window = flat[bounds[first]:bounds[i]]
        at = bounds[first:i] - bounds[first]
        both = np.add.reduceat(present[window], at, dtype=np.int64)[other - first]
        present[mine] = False
        end = np.minimum(ends[other], ends[i])
        ours = np.searchsorted(mine, end, side="right")
        theirs = np.diff(bounds)[other]
        cut = np.flatnonzero(ends[other] > end)   # only these reach beyond the common end
        theirs[cut] = [np.searchsorted(flat[bounds[j]:bounds[j + 1]], ends[i], side="right") for j in other[cut]]
        estimate = both / np.maximum(ours + theirs - both, 1)
        whole = (n[other] <= SKETCH) & (n[i] <= SKETCH)
        # the likeliest first: a link spares the comparisons with the rest of its component
        for k in np.lexsort((other, -estimate)):
            if estimate[k] < LEAST_ESTIMATE:
                break
            j = int(other[k])
            if component[j] == component[i]:
                continue
            common = int(both[k]) if whole[k] else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common * 100 >= percent * (n[i] + n[j] - common):
                links.append((order[j], order[i]))
                component[component == component[j]] = component[i]
    return links


def _cell_links(percent: int):
    """Links of each cell; rows come sorted by cell."""
    def settle(held: list[tuple]) -> pa.RecordBatch:
        _, sid, root, side, sets = zip(*held)
        pairs = linked_members([np.array(x, np.int64) for x in sets], root, side, percent)
        a, b = ([min(sid[i], sid[j]) for i, j in pairs], [max(sid[i], sid[j]) for i, j in pairs])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            cell, sid, root, side = (batch.column(c).to_pylist() for c in range(4))
            bounds, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for i in range(batch.num_rows):
                if held and held[0][0] != cell[i]:
                    yield settle(held)
                    held = []
                held.append((cell[i], sid[i], root[i], side[i], values[bounds[i]:bounds[i + 1]].copy()))
        if held:
            yield settle(held)
    return rows


class _Linker:
    """Confirms candidate pairs, best first, and keeps the components that they form."""

    def __init__(self, rows: DataFrame, sets: DataFrame, percent: int):
        self.rows, self.sets, self.percent = rows, sets, percent
        self.roots = sets.select(F.col("sid").alias("id"), F.col("sid").alias("root")).limit(0)
        self.roots = materialize(self.roots)

    def rooted(self, pairs: DataFrame) -> DataFrame:
        for side in "ab":
            r = self.roots.select(F.col("id").alias(side), F.col("root").alias(f"r{side}"))
            pairs = pairs.join(r, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
        return pairs

    def full_sets(self, ids: DataFrame, within: Scratch | None = None) -> DataFrame:
        """All shingle hashes of the sets ``sid``: the sketch of a small one, the whole text of the first document for others."""
        named = self.sets.join(ids.hint("shuffle_hash"), "sid")
        large = named.where(F.col("n") > SKETCH).select("sid", F.col("owner.doc").alias("d"), F.col("owner.text_hash").alias("h"))
        texts = self.rows.join(large.hint("shuffle_hash"), (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h")))
        read = texts.select("sid", "text").mapInArrow(_full_rows, _FULL).dropDuplicates(["sid"])
        return materialize(named.where(F.col("n") <= SKETCH).select("sid", F.col("sketch").alias("hashes")).unionByName(read), within=within)

    def link(self, pairs: DataFrame) -> None:
        """Join the components of the pairs that are linked. Whole sets are decided by their sketches; of the others those
        with a sufficient estimate are confirmed, each set's best two first, then all that are still apart."""
        sketch = self.sets.select("sid", "n", "sketch")
        for side in "ab":
            pairs = pairs.join(sketch.withColumnsRenamed({"sid": side, "n": f"n_{side}", "sketch": f"sketch_{side}"}), side)
        pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        pairs = pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_estimates, _LINKS + ", estimate double, whole boolean")
        # the quotient of two small whole numbers is at least percent / 100 when it is so exactly
        pairs = materialize(pairs.where(F.col("estimate") >= F.when(F.col("whole"), self.percent / 100).otherwise(LEAST_ESTIMATE)))
        self.join_roots(pairs.where("whole").select("a", "b"))
        pairs = pairs.where(~F.col("whole"))
        apart = materialize(self.rooted(pairs).where("ra <> rb").select("a", "b"))
        if apart.isEmpty():
            return
        own = Scratch(self.sets.sparkSession)
        full = self.full_sets(apart.select(F.col("a").alias("sid")).union(apart.select("b")).distinct(), own)
        tested = None
        for most in (2, None):
            still = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            still = self.rooted(still).where("ra <> rb")
            if most:
                rank = [F.row_number().over(Window.partitionBy(s).orderBy(F.desc("estimate"), "a", "b")) for s in "ab"]
                still = still.withColumn("ka", rank[0]).withColumn("kb", rank[1]).where(F.least("ka", "kb") <= most)
            still = materialize(still.select("a", "b", "ra", "rb"))
            if still.isEmpty():
                break
            checked = still
            for side in "ab":
                checked = checked.join(full.withColumnsRenamed({"sid": side, "hashes": f"set_{side}"}), side)
            both = F.size(F.array_intersect("set_a", "set_b"))
            union = F.size("set_a") + F.size("set_b") - both
            tested = still.select("a", "b")
            self.join_roots(checked.where(both * 100 >= union * self.percent).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        own.close()

    def join_roots(self, edges: DataFrame) -> None:
        """Join the components of linked sets (or of their roots)."""
        edges = self.rooted(edges).where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = materialize(edges.distinct())
        if edges.isEmpty():
            return
        merged = components(edges).select(F.col("id").alias("root"), F.col("root").alias("top"))
        known = self.roots.join(merged, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        fresh = merged.withColumnsRenamed({"root": "id", "top": "root"}).join(self.roots.select("id"), "id", "left_anti")
        self.roots = materialize(known.unionByName(fresh))


def _apart(entries: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries with their roots, and the lists (with the number of values of their members) that hold several components.

    Near copies share many values: of lists with the same members, one is given out.
    """
    rooted = entries.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lists = rooted.groupBy("list").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("values"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("sid")).alias("mark"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("other_mark"))
    unlike = lists.where("lo <> hi").groupBy("members", "mark", "other_mark").agg(F.min("list").alias("list"), F.first("values").alias("values"))
    return rooted, unlike.select("list", "values")


def _rarest_first(sets: DataFrame, members: DataFrame, percent: int, within: Scratch | None = None) -> DataFrame:
    """Entries (list, sid, n) of each member's rarest retained values, as many as surely hold one that a linked set has there too.

    With all values in one order, two sets that share all but d of s values share one of their first d + 1. A set that is its
    own sketch may lack 15 of 100; for others the sketches of two linked sets may differ by a little more.
    """
    few = materialize(sets.join(members.hint("shuffle_hash"), "sid").select("sid", "n", "sketch"), within=within)   # read twice
    own = few.select("sid", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("list"))
    often = own.groupBy("list").agg(F.count(F.lit(1)).alias("times"))
    ranked = own.join(often.hint("shuffle_hash"), "list").groupBy("sid", "n", "s").agg(F.sort_array(F.collect_list(F.struct("times", "list"))).alias("all"))
    whole = F.col("n") * 100 < SKETCH * percent   # surely compared with whole sets only
    lack = F.floor(F.col("s") * F.when(whole, 100 - percent).otherwise(100 * (1 - LEAST_ESTIMATE)) / 100).cast("int")
    first = ranked.withColumn("first", lack + 1).select("sid", "n", F.explode(F.slice("all", 1, F.col("first"))).alias("e"))
    return first.where("e.times > 1").select("e.list", "sid", "n")


def _cell_rows(entries: DataFrame, lists: DataFrame, full: DataFrame) -> DataFrame:
    """The members of ``lists`` with their sets: one row for each cell (two blocks of a list) that they are in."""
    lists = materialize(lists.select("list", F.ceil(F.col("values") / BLOCK_VALUES).cast("int").alias("blocks")))
    left = entries.join(lists, "list").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cells = left.select("list", "sid", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select(F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "sid", "root",
                         F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    return cells.join(full, "sid").select("cell", "sid", "root", "side", "hashes").repartition("cell").sortWithinPartitions("cell")


def _runs_of(run: int, least: int, below: int | None) -> Column:
    """Hashes of all runs of ``run`` listed values, for sets of ``least`` values or more (and less than ``below``)."""
    fits = (F.col("n") >= least) & (F.col("n") < (below or 2**62))
    places = F.sequence(F.lit(0), F.size("listed") - run)
    runs = F.transform(places, lambda i: F.xxhash64(F.lit(run), *[F.get("listed", i + j) for j in range(run)]))
    return F.when(fits, runs).otherwise(F.array().cast("array<bigint>"))


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The near-duplicate class of every row: ``key``, n_shingles, component_id, text_hash, first.

    A text is lower-cased (A-Z) and split at ASCII white space; its set holds its distinct runs of five words, or
    its whole word sequence if it is shorter. Two texts are linked when their intersection has at least
    ``percent`` (85 or more) hundredths of their union. component_id is the smallest ``key`` that can be reached by
    links; ``first`` marks its smallest row by key and text hash (rows that repeat both are all marked). Texts without words and null
    texts are linked with nothing and are all marked. A null key counts as the
    smallest; repeated rows are in one class. Other columns are not read. Runs jobs when called.

    1. Equal sets are collapsed (combined before the shuffle), so copies never meet again.
    2. Neighbours in each list of runs, ordered by size, are estimated from their sketches and, where these are not the whole
       sets, confirmed on full sets. The lists are range-partitioned, so a long one spans many tasks, and none is expanded
       into pairs.
    3. Members of lists that still hold several components enter the lists of their rarest retained values, which are
       compared in blocks of bounded size, each pair of components until it is linked. A cell returns the links that join its
       components, fewer than it has members.
    """
    if percent < 85:
        raise ValueError("the lists are laid out for similarities of 0.85 and more")
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("doc"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    early = Scratch(docs.sparkSession)   # sketches are kept once per set, not per row
    sketched = materialize(rows.mapInArrow(_set_rows, _SETS), within=early)
    sets = sketched.where("n > 0").groupBy("set_id").agg(
        F.min(F.struct("doc", "text_hash")).alias("owner"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = materialize(sets.withColumn("sid", F.monotonically_increasing_id()))
    members = materialize(sketched.drop("sketch"))
    early.close()
    listed = sets.withColumn("listed", F.slice("sketch", 1, LISTED))
    entries = listed.select(F.explode(F.concat(*[_runs_of(*r) for r in RUNS])).alias("list"), "sid", "n")
    entries = entries.repartitionByRange("list", "n", "sid").sortWithinPartitions("list", "n", "sid")
    entries = materialize(entries.mapInArrow(_shared_lists, "list bigint, sid bigint, n bigint"))
    linker = _Linker(rows, sets, percent)
    linker.link(entries.select("list", "sid").mapInArrow(_neighbours, _LINKS).distinct())

    rooted, apart = _apart(entries, linker.roots)
    rest = materialize(rooted.join(apart.select("list"), "list", "left_semi").select("sid").distinct())
    chosen = Scratch(docs.sparkSession)
    rarest = materialize(_rarest_first(sets, rest, percent, chosen))
    chosen.close()
    rooted, apart = _apart(rarest, linker.roots)
    apart = materialize(apart)
    rooted = materialize(rooted.join(apart.select("list"), "list", "left_semi"))
    full = linker.full_sets(rooted.select("sid").distinct())
    linker.join_roots(_cell_rows(rooted, apart, full).mapInArrow(_cell_links(percent), _LINKS))

    classes = sets.join(linker.roots, F.col("sid") == F.col("id"), "left").select("set_id", F.coalesce("root", "sid").alias("root"), "owner")
    least = classes.groupBy("root").agg(F.min("owner").alias("first"))
    classes = materialize(classes.join(least, "root").select("set_id", F.col("first.doc").alias("component"), F.col("first.text_hash").alias("first_hash")))
    out = members.select("doc", "text_hash", "n", "set_id").join(classes, "set_id", "left")
    first = F.col("set_id").isNull() | ((F.col("doc") == F.col("component")) & (F.col("text_hash") == F.col("first_hash")))
    return out.select(F.nullif("doc", F.lit(NO_KEY)).alias(key), F.col("n").alias("n_shingles"),
                      F.nullif(F.coalesce("component", "doc"), F.lit(NO_KEY)).alias("component_id"), "text_hash", first.alias("first"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near copies: of every class the row with the smallest ``key`` (and text hash) stays.

    Rows that repeat a key with other texts are documents of their own. Of rows that repeat key and text the
    smallest by its other columns stays; texts without words are linked with nothing, so all their rows stay.
    """
    kept = near_duplicates(docs, text=text, key=key).where("first")
    times = kept.groupBy(F.col(key).alias("kept_key"), F.col("text_hash").alias("kept_hash"), (F.col("n_shingles") > 0).alias("worded")).agg(F.count(F.lit(1)).alias("times"))
    times = materialize(times).hint("shuffle_hash")
    found = docs.join(times, F.col(key).eqNullSafe(F.col("kept_key")) & (F.xxhash64(F.col(text)) == F.col("kept_hash")))
    single = (F.col("times") == 1) | ~F.col("worded")
    repeated = found.where(~single).groupBy("kept_key", "kept_hash").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return found.where(single).select(*docs.columns).unionByName(repeated.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, arcs.b FROM reach JOIN arcs ON reach.b = arcs.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""
