"""Document fingerprints: invertible Bloom lookup sketches over paragraphs, which tell two versions of a text apart.

A text's paragraphs (what line ends and sentence ends part) have digests of 60 bits. A sketch has three rows of cells;
each digest goes into one cell of each row, and a cell holds how many digests it got, their xor, and the xor of their checks. Sketches
of one size subtract cell by cell: what both texts share cancels, and the cells hold the digests of the differing paragraphs. A cell that is
left with one digest gives it away; taking it out of its other two cells frees more (peeling). Where cells remain,
the sketch was too small for that pair, and a larger one is made.

All of it is DataFrame work. Cells are rows, grouped by pair and cell. Peeling goes row of cells by row of cells,
so that a digest shows in one cell at a time; each step is one grouping. Pairs are hashed over the partitions once, and as every grouping
contains the pair's key, no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietday.llm.common import cut, scratch_path, text_or_empty

#: What parts paragraphs; the same pattern in Java and RE2.
PARTING = r"[.!?][ \t]+|\n+"
#: Cells of a row in a fingerprint. A sketch for n differing digests gets PER_DIGEST n + SPARE cells in each of its three rows.
FINGERPRINT_CELLS, PER_DIGEST, SPARE = 4, 0.7, 6
#: Keys (of 16 bytes) that are broadcast to pick the texts of failed pairs; beyond, both sides are shuffled.
PICKED = 1_000_000
#: Times that all three rows are peeled; a pair that is not done by then counts as failed.
TURNS = 3
#: A prime, and factors for checks and for the third row's places (fixed values, below 2^31).
PRIME = 2_147_483_647
LOW = (1 << 30) - 1
CHECK, THIRD = (1_640_531_527, 1_013_904_223), (1_597_334_677, 741_103_597)

_KEY = ["pair", "again"]


def digest(paragraph: Column) -> Column:
    return F.conv(F.substring(F.md5(paragraph), 1, 15), 16, 10).cast("long")


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none of an empty text."""
    parts = F.filter(F.split(text, PARTING), lambda x: x != "")
    return F.array_distinct(F.transform(parts, digest))


def _mixed(key: str, factors: tuple[int, int]) -> str:
    return f"((shiftright({key}, 30) * {factors[0]}L + ({key} & {LOW}L) * {factors[1]}L) % {PRIME}L)"


def check(key: str) -> str:
    """SQL of a digest's check. Expressions that are used at every step are SQL texts: they are parsed once, not put together call by call."""
    return _mixed(key, CHECK)


def place(key: str, row: int, cells: str) -> str:
    """SQL: which of the sketch's 3 * cells cells holds the digest in this row."""
    half = (f"({key} & {LOW}L)", f"shiftright({key}, 30)", _mixed(key, THIRD))[row]
    return f"({cells} * {row}L + {half} % {cells})"


def sketch(digests: str, cells: int = FINGERPRINT_CELLS) -> Column:
    """A small sketch of a column of digests as an array of (n, key, chk), built inside the row."""
    # names that no column has
    x, cell, sum_ = "x__", "cell__", "sum__"
    at = f"element_at(array({', '.join(place(x, row, f'{cells}L') for row in range(3))}), CAST({cell} DIV {cells} AS INT) + 1)"
    nothing = "named_struct('n', 0L, 'key', 0L, 'chk', 0L)"
    add = f"named_struct('n', {sum_}.n + 1L, 'key', {sum_}.key ^ {x}, 'chk', {sum_}.chk ^ {check(x)})"
    return F.expr(f"transform(sequence(0L, {3 * cells - 1}L), {cell} -> aggregate(filter({digests}, {x} -> {at} = {cell}), {nothing}, ({sum_}, {x}) -> {add}))")


def subtract(a: Column, b: Column) -> Column:
    """The sketch of what differs: counts subtracted, the rest by xor."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["chk"].bitwiseXOR(y["chk"]).alias("chk")))


def written_out(cells: Column) -> Column:
    """A sketch as hex digits: 8 of the count, 15 of the digests' xor, 8 of the checks' xor, for each cell."""
    digits = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    return F.array_join(F.transform(cells, lambda c: F.concat(digits(c["n"], 8), digits(c["key"], 15), digits(c["chk"], 8))), "")


def _peeled(cells: DataFrame, keys: list[str], turns: int, listed: bool) -> DataFrame:
    """keys, side (-2: left only, -3: right only, 0 and above: a cell that remains), found (the digest, if listed), n of each pair of sketches.

    `cells` has keys, size, cell, found, n, key, chk, one row for each digest and place; other rows have a negative cell.
    """
    group = [*keys, "size", "cell", "found"]

    def gathered(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*group).agg(F.expr("sum(n) AS n"), F.expr("bit_xor(key) AS key"), F.expr("bit_xor(chk) AS chk"))
        return out.where("cell < 0 OR n <> 0 OR key <> 0 OR chk <> 0")

    rows = gathered(cells)
    for turn in range(3 * turns):
        row = turn % 3
        pure = f"abs(n) = 1 AND chk = {check('key')} AND cell = {place('key', row, 'size')} AND cell >= 0"
        # a digest found stands for itself, and leaves its two other cells
        found = "IF(pure, key, found)" if listed else "found"
        own = f"IF(pure, IF(n > 0, -2L, -3L), cell), {found}, IF(pure, 1L, n), IF(pure, 0L, key), IF(pure, 0L, chk)"
        far = [f"IF(pure, {place('key', r, 'size')}, NULL), found, -n, key, chk" for r in range(3) if r != row]
        three = f"stack(3, {own}, {far[0]}, {far[1]}) AS (cell, found, n, key, chk)"
        rows = gathered(rows.selectExpr("*", f"{pure} AS pure").selectExpr(*keys, "size", three).where("cell IS NOT NULL"))
    return rows


def _placed(elements: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of the three cells of a digest; rows with a negative size pass once, in the cell of that number."""
    rest = f"0L, n, key, {check('key')}"
    cells = [f"IF(size < 0, {'size' if r == 0 else 'NULL'}, {place('key', r, 'size')})" for r in range(3)]
    three = f"stack(3, {', '.join(f'{c}, {rest}' for c in cells)}) AS (cell, found, n, key, chk)"
    return elements.selectExpr(*keys, "size", three).where("cell IS NOT NULL")


def cells_for(digests: Column, grow: int = 1) -> Column:
    """Cells of a row, for that many differing digests."""
    return (F.ceil(digests * PER_DIGEST) + SPARE).cast("long") * grow


def differences(pairs: DataFrame, key: str, left: str, right: str, expected: Column | None = None, turns: int = TURNS) -> DataFrame:
    """key, left_only, right_only: the digests of two arrays of digests that the other lacks, by sketches, subtracted and peeled.

    `expected` is how many are thought to differ (all, if not given); pairs that fail are tried again at four times the size, until none
    fails. Keys tell rows apart. Null arrays are empty, repeated digests count once. An empty table gives no rows.
    """
    nothing = F.array().cast("array<long>")
    some = lambda c: F.array_distinct(F.coalesce(F.col(c), nothing))
    pairs = pairs.select(F.col(key).alias("_key"), some(left).alias("_a"), some(right).alias("_b"), (expected if expected is not None else F.size(some(left)) + F.size(some(right))).alias("_n"))
    done, open_pairs, grow = None, cut(pairs), 1
    while True:
        size = cells_for(F.col("_n"), grow)
        signed = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("key"), F.lit(n).cast("long").alias("n")))
        mark = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n")))
        elements = open_pairs.repartition("_key").select("_key", size.alias("_size"), F.explode(F.concat(mark, signed("_a", 1), signed("_b", -1))).alias("x"))
        # a row of size -1 keeps pairs that don't differ
        elements = elements.select("_key", F.when(F.col("x.n") == 0, -1).otherwise(F.col("_size")).cast("long").alias("size"), "x.key", "x.n")
        rows = _peeled(_placed(elements, ["_key"]), ["_key"], turns, True)
        only = lambda side: F.sort_array(F.collect_list(F.when(F.col("cell") == side, F.col("found"))))
        found = rows.groupBy("_key").agg(only(-2).alias("left_only"), only(-3).alias("right_only"), F.count_if(F.col("cell") >= 0).alias("left"))
        found = cut(found)
        good = found.where("left = 0").select(F.col("_key").alias(key), "left_only", "right_only")
        done = good if done is None else done.unionByName(good)
        failed = found.where("left > 0").select("_key")
        if failed.isEmpty():
            return done
        open_pairs, grow = cut(open_pairs.join(failed, "_key", "left_semi")), grow * 4


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    # never null, and known to be, so that joins need not compute it once more to filter
    return rows.withColumn("pair", F.coalesce(F.unhex(F.md5(F.concat(name, F.lit(":"), F.col("text")))), F.lit(bytearray(b""))))


def _once(rows: DataFrame) -> DataFrame:
    """Repeated rows shrunk to one, before texts meet."""
    return rows.groupBy("pair").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text"))


def _links(rows: DataFrame) -> DataFrame:
    """pair, again, times, next, half: which row comes next in ascending order of doc_id (null first) and text hash; after the last, the first.

    Of equal rows each but the last comes before another of them: `again` rows, `times` of them.
    """
    keys = rows.groupBy("pair").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n_chars"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("pair").asc()]
    ranged = cut(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "pair"))["pair"]
    firsts = ranged.groupBy("part").agg(first.alias("first"))  # as many rows as partitions
    over = Window.orderBy("part")
    firsts = firsts.select(F.col("part"), F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(Window.unboundedPreceding, 0))).alias("following"))
    inside = ranged.withColumn("next", F.lead("pair").over(Window.partitionBy("part").orderBy(*order)))
    half = F.floor(F.col("n_chars") / 2).cast("int").alias("half")
    last = inside.join(firsts, "part").select("pair", F.lit(False).alias("again"), F.lit(1).cast("long").alias("times"), F.coalesce("next", "following").alias("next"), half)
    same = ranged.where("copies > 1").select("pair", F.lit(True).alias("again"), (F.col("copies") - 1).alias("times"), F.col("pair").alias("next"), half)
    return cut(last.unionByName(same))


def _pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """For each link: the text's digests, the edited text and its digests, and the next text's digests.

    Both joins deal the same rows out by `pair`, under the same names, so Spark shuffles the texts once.
    """
    rows = rows.select("pair", "doc_id", "text")
    after = links.alias("l").join(rows.alias("n"), F.col("l.next") == F.col("n.pair"))
    after = after.select(F.col("l.pair").alias("pair"), "again", "times", "half", F.col("n.doc_id").alias("next_id"), F.left("n.text", F.col("half")).alias("head"), paragraph_digests(F.col("n.text")).alias("c"))
    both = rows.join(after, "pair").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("half")), F.col("head"))
    both = both.select(*_KEY, "times", "doc_id", "next_id", "n_chars", paragraph_digests(F.col("text")).alias("a"), edited.alias("edited"), "c")
    return both.select(*_KEY, "times", "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", paragraph_digests(F.col("edited")).alias("b"), "c")


def _compared(pairs: DataFrame, grow: int, turns: int) -> DataFrame:
    """The rows of `pairs` with fingerprints and the likeness of both sketches; `open`: cells that remain."""
    a, b, c = (F.size(x) for x in "abc")
    facts = F.struct("times", "doc_id", "next_id", "n_chars", "edited_sha256", F.col("a_print").alias("fingerprint"), F.col("b_print").alias("edited_fingerprint"), a.alias("na"), b.alias("nb"), c.alias("nc"))
    pairs = pairs.withColumn("a_print", written_out(sketch("a"))).withColumn("b_print", written_out(sketch("b")))
    pairs = pairs.withColumn("facts", facts).withColumn("s0", cells_for(a + b, grow)).withColumn("s1", cells_for(a + c, grow))
    none = F.lit(None).cast(pairs.schema["facts"].dataType)

    def signed(digests: str, which: int, n: int) -> Column:
        return F.transform(digests, lambda x: F.struct(F.lit(which).alias("which"), F.col(f"s{which}").alias("size"), x.alias("key"), F.lit(n).cast("long").alias("n"), none.alias("facts")))

    zero = F.lit(0).cast("long")
    own = F.array(F.struct(F.lit(-1).alias("which"), F.lit(-1).cast("long").alias("size"), zero.alias("key"), zero.alias("n"), F.col("facts").alias("facts")))
    elements = pairs.select(*_KEY, F.explode(F.concat(own, signed("a", 0, 1), signed("b", 0, -1), signed("a", 1, 1), signed("c", 1, -1))).alias("x")).select(*_KEY, "x.*")
    keys = [*_KEY, "which", "facts"]
    rows = _peeled(_placed(elements, keys), keys, turns, False)

    def differing(which: int) -> Column:
        return F.sum(F.when((F.col("which") == which) & F.col("cell").isin(-2, -3), F.col("n")).otherwise(0))

    sides = lambda which: F.sum(F.when(F.col("which") == which, F.when(F.col("cell") == -2, F.col("n")).when(F.col("cell") == -3, -F.col("n"))).otherwise(0))
    found = rows.groupBy(*_KEY).agg(
        F.max("facts").alias("facts"), differing(0).alias("d0"), differing(1).alias("d1"), sides(0).alias("e0"), sides(1).alias("e1"), F.count_if((F.col("which") >= 0) & (F.col("cell") >= 0)).alias("open")
    )
    found = found.select(*_KEY, "facts.*", "d0", "d1", "e0", "e1", "open")
    # both sides found have to explain the numbers of paragraphs
    wrong = (F.col("e0") != F.col("na") - F.col("nb")) | (F.col("e1") != F.col("na") - F.col("nc"))
    return found.withColumn("open", F.when(wrong, F.col("open") + 1).otherwise(F.col("open"))).drop("e0", "e1")


def _like(ours: str, theirs: str, differing: str) -> Column:
    """The share of paragraphs that both have among those that either has; 1 if neither has any."""
    both = F.col(ours) + F.col(theirs)
    return F.when(both + F.col(differing) == 0, F.lit(1.0)).otherwise((both - F.col(differing)) / (both + F.col(differing)))


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS, grow: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id.

    The edited text is the text with its last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document's, in ascending order of doc_id, null ids first, equal ids by a hash of the text; after the last comes the first, and a
    single document comes after itself. Of repeated rows each but the last is followed by another of them. A fingerprint is a sketch of
    twelve cells in hex. Likeness is the Jaccard index of two texts' sets of paragraph digests, recovered by peeling sketches of a fitting
    size, four times the size for pairs that failed, and so on; two texts without paragraphs are alike. Null text is empty and has none.
    A text is digested whole, however long. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    links = _links(rows)
    repeated = not links.where("again").isEmpty()
    if repeated:
        rows = _once(rows)
    done = None
    while True:
        path = scratch_path(spark, "likeness")
        _compared(_pairs(rows, links), grow, turns).write.option("compression", "zstd").parquet(path)
        found = spark.read.parquet(path)
        good = found.where("open = 0")
        done = good if done is None else done.unionByName(good)
        failed = found.where("open > 0").select(*_KEY)
        if failed.isEmpty():
            break
        grow *= 4
        links = cut(links.join(failed, _KEY, "left_semi"))
        wanted = cut(links.select("pair").union(links.select("next")).distinct())
        # the texts of few pairs are picked out where they are read, without a shuffle of all texts
        wanted = F.broadcast(wanted) if wanted.count() <= PICKED else wanted
        rows = _keyed(docs, id_col, text_col).join(wanted, "pair", "left_semi")
        if repeated:
            rows = _once(rows)
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", _like("na", "nb", "d0").alias("near_edited"), _like("na", "nc", "d1").alias("near_next"), "next_id")
