r"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

Lines are compared in lower case without outer blanks, as sets of character shingles of ``SHINGLE`` code points
(a shorter line is one shingle), told apart by 64-bit hashes. A hash's upper bits name one of ``CLASSES``
classes, and the ``ROWS`` least hashes of a class are a band: lines that share a band are candidates. Classes
have no hash in common, so bands miss independently: at similarity s all do with (1 - s^ROWS)^CLASSES, 1 in
2,000 or fewer at 0.8. Lines of few distinct shingles, where classes would be near empty, have bands that miss no
pair of at least ``SIMILARITY``:

* from ``FEW[0]`` to ``FEW[1]`` distinct shingles, every run of ROWS neighbours in the order of hashes: what two
  lines do not share are at most 1 in 5 of their hashes together, too few to break all runs from 16 hashes on;
* under ``LEAST``, every choice of ROWS among the ROWS + m least, as at most m = (1 - SIMILARITY) n of a line's n
  shingles are not in a like line.

The kinds overlap so far that lines of similarity 0.8 always share one, and they go by distinct shingles, so
neither length nor repetition tells like lines apart.

Candidates are verified by exact Jaccard similarity over all shingles: first each line against the least line of each
of its bands; then, in bands that still have several components, lines outside the commonest component against the
lines of other components, as far as sizes and sketches allow that they are like. Where these are many, as in large groups
of near copies, each line is first compared with few pivots of its band: what they link need not be compared again, and
the last round compares all that are still apart. So pivots only save, they drop no pair. The first pivot is the line that shares most with others, as a group's middle links more of it than its rim does.
Components follow by keyed contraction. Every component keeps its first line, by doc_id and line number.

A band that holds very many lines is dealt over ``SALTS`` tasks, each with a least line of its own, and these are
linked to the band's least line in the same way.

Cases: lines without a word (and so empty and null texts) are kept and never compared; identical lines are one
node by a 64-bit hash; with a repeated row (a doc_id twice, same text) the lines of both rows are equals, and
those at the component's first place all stay. Lines of any length are read whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_key, components, cut, free_name, let, read, release

#: All blanks that a line can have: the split leaves no line feed.
BLANKS = " \t\r\v\f"
SHINGLE = 7
SIMILARITY = 0.8
ROWS = 4
CLASS_BITS = 4
CLASSES = 1 << CLASS_BITS
#: Lines with fewer distinct shingles than LEAST have exact choices, those from FEW[0] to FEW[1] all runs, those with
#: FEW[2] or more the bands of classes. Like sets always share a kind: FEW[0] <= 0.8 LEAST and FEW[2] <= 0.8 FEW[1].
LEAST = 20
FEW = (16, 48, 38)
#: Of a line of more than WANTED shingles only the hashes below a limit are sorted, about WANTED of them; if repetition
#: leaves fewer than ENOUGH distinct ones, all are.
WANTED, ENOUGH = 96, 64
#: A class of a line whose hashes are all known needs so many for a band; fewer would be common by chance.
LEAST_IN_CLASS = 2
#: Up to so many lines are sent to all executors to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bands are counted over one line in SAMPLE (by hash); those met HOT times or more there are dealt over SALTS tasks.
SAMPLE, HOT, SALTS = 64, 500, 64
#: Bands with more than WIDE lines outside their commonest component have rounds of so many PIVOTS before the rest is compared.
WIDE, PIVOTS = 8, (1, 8)

#: Choices of ROWS places, those that need the fewest least hashes first.
_CHOICES = sorted(combinations(range(ROWS + int((1 - SIMILARITY) * LEAST + 1e-9)), ROWS), key=lambda c: c[-1])
_LOW = (1 << (64 - CLASS_BITS)) - 1
#: The least hash of each class.
_MARKS = [(k << (64 - CLASS_BITS)) - (1 << 63) for k in range(CLASSES)]


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines with a word, in the form in which they are compared.

    Trimming by a set of characters walks the whole line, so only lines with a blank at an end go through it; all others
    that are not empty have a word.
    """
    own = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    raw = F.col("raw")
    edged = reduce(or_, (test for c in BLANKS for test in (raw.startswith(c), raw.endswith(c))))
    with_word = F.when(edged, F.trim(raw, F.lit(BLANKS)) != "").otherwise(raw != "")
    return own.where(with_word).select("doc_id", "line_no", F.when(edged, F.trim(F.lower(raw), F.lit(BLANKS))).otherwise(F.lower(raw)).alias("line"))


def shingle_hashes(line: Column) -> Column:
    """The hashes of a line's shingles in order of place. Four bytes a code point, so that a shingle is a slice of bytes."""
    wide = 4 * SHINGLE
    slices = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - (wide - 1), F.lit(4)), lambda i: F.xxhash64(F.substr(b, i, F.lit(wide))))
    return let(F.encode(line, "UTF-32"), lambda b: F.when(F.octet_length(b) < wide, F.array(F.xxhash64(b))).otherwise(slices(b)))


def signed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``whole`` and ``s``: distinct shingle hashes in order, all of them (``whole``) or those under the line's limit,
    and the columns of ``by_class``."""
    some = lines.withColumn("hashes", shingle_hashes(F.col("line")))
    limit = (F.lit(float(WANTED << (64 - CLASS_BITS))) / F.greatest(F.size("hashes"), F.lit(WANTED))).cast("long")
    low = let(limit, lambda most: F.filter("hashes", lambda x: x.bitwiseAND(F.lit(_LOW)) < most))
    some = some.withColumn("s", F.sort_array(F.array_distinct(F.when(F.size("hashes") <= WANTED, F.col("hashes")).otherwise(low))))
    some = some.withColumn("whole", (F.size("hashes") <= WANTED) | (F.size("s") < ENOUGH))
    every = F.when((F.size("hashes") > WANTED) & F.col("whole"), F.sort_array(F.array_distinct("hashes"))).otherwise(F.col("s"))
    return by_class(some.withColumn("s", every)).drop("hashes")


def by_class(hashed: DataFrame) -> DataFrame:
    """``hashed`` with ``v``, the hashes ``s`` in order among the marks of classes, and the places ``p`` of the marks there."""
    some = hashed.withColumn("v", F.sort_array(F.concat("s", F.array(*map(F.lit, _MARKS)))))
    return some.withColumn("p", F.array(*[F.array_position("v", F.lit(m)).cast("int") for m in _MARKS], F.size("v") + 1))


def sketch() -> Column:
    """An odd sketch of a row of ``by_class``: a word a class, whose bits tell whether a hash has set them an odd number of times.

    Two sketches differ in no more bits than their sets in elements, as common elements cancel out.
    """

    def word(k: int) -> Column:
        own = F.slice("v", F.get("p", F.lit(k)) + 1, F.get("p", F.lit(k + 1)) - F.get("p", F.lit(k)) - 1)
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x))), F.lit(0).cast("long"))

    return F.struct(*[word(k).alias(f"w{k}") for k in range(CLASSES)])


def may_be_like(a: str, b: str, similarity: float) -> Column:
    """Whether lines of ``n_a`` and ``n_b`` shingles with sketches ``sketch_a`` and ``sketch_b`` can be like; never false of like ones.

    Sets of at least ``similarity`` differ in (1 - similarity) / (1 + similarity) of their sizes' sum at most.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    differ = sum((F.bit_count(F.col(f"sketch_{a}.w{k}").bitwiseXOR(F.col(f"sketch_{b}.w{k}"))) for k in range(1, CLASSES)), F.bit_count(F.col(f"sketch_{a}.w0").bitwiseXOR(F.col(f"sketch_{b}.w0"))))
    return (F.least(n_a, n_b) >= F.lit(similarity) * F.greatest(n_a, n_b)) & (F.lit(1 + similarity) * differ <= F.lit(1 - similarity) * (n_a + n_b) + F.lit(1e-6))


def _band(s: Column, places: list) -> Column:
    return F.xxhash64(*[F.coalesce(F.get(s, p), F.lit(0)) for p in places])


def _exact_bands(s: Column) -> Column:
    """Every choice of ROWS hashes of a short line's prefix: of its ROWS least hashes and as many more as a like line may lack."""
    spare = F.floor(F.size(s) * (1 - SIMILARITY) + 1e-9)
    sizes = F.array(*[F.lit(comb(ROWS + m, ROWS)) for m in range(_CHOICES[-1][-1] - ROWS + 2)])
    choices = F.array(*[F.array(*map(F.lit, c)) for c in _CHOICES])
    return F.transform(F.slice(choices, 1, F.get(sizes, spare.cast("int"))), lambda c: _band(s, [c[k] for k in range(ROWS)]))


def _class_bands() -> Column:
    """The ROWS least hashes of each class, or null; of ``whole`` lines also all of a class with fewer, from LEAST_IN_CLASS on.

    Spelled out class by class and under no function over arrays, so that it is generated code.
    """

    def band(k: int) -> Column:
        at = F.get("p", F.lit(k))
        n = F.get("p", F.lit(k + 1)) - at - 1
        return F.when(n >= F.when(F.col("whole"), LEAST_IN_CLASS).otherwise(ROWS), F.xxhash64(F.slice("v", at + 1, F.least(n, F.lit(ROWS)))))

    return F.array(*map(band, range(CLASSES)))


def bands() -> Column:
    """The bands of a line of ``signed``, as longs; nulls are none."""
    none = F.array().cast("array<bigint>")
    s, n, few = F.col("s"), F.size("s"), F.col("whole") & (F.size("s") < FEW[1])
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (ROWS - 1)), lambda i: F.xxhash64(F.slice(v, i, ROWS)))
    exact = F.when(few & (n < LEAST), let(s, _exact_bands)).otherwise(none)
    return F.concat(exact, F.when(few & (n >= FEW[0]), let(s, runs)).otherwise(none), F.when(~F.col("whole") | (n >= FEW[2]), _class_bands()).otherwise(none))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least ``similarity``, over all shingles; sizes and sketches of both sets are compared first."""
    left, right = (texts.select(F.col("h").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("line", "n", "sketch")]) for k in "ab")
    near = pairs.join(by_key(left), "a").join(by_key(right), "b").where(may_be_like("a", "b", similarity))
    both = F.size(F.array_intersect(shingle_hashes(F.col("line_a")), shingle_hashes(F.col("line_b"))))
    return near.withColumn("both", both).where(F.col("both") >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def hot_bands(entered: DataFrame) -> DataFrame:
    """(band, hot): those that very many lines share, by a count over one line in SAMPLE. It steers where rows go, not what comes out."""
    return entered.where(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("band", F.lit(True).alias("hot"))


def band_members(signatures: DataFrame) -> DataFrame:
    """(band, h, first): the lines of every band that more than one line has, with the band's (or salt's) least line."""
    entered = signatures.select("h", F.explode("bands").alias("band")).where("band IS NOT NULL")
    hot = cut(hot_bands(entered))
    some_hot, salt = not hot.isEmpty(), F.lit(0)
    if some_hot:
        entered = entered.join(F.broadcast(hot), "band", "left")  # one band for each HOT x SAMPLE rows at most
        salt = F.when(F.col("hot"), 1 + F.pmod("h", F.lit(SALTS))).otherwise(0)
    keys = entered.select("band", "h", salt.cast("int").alias("salt"))
    within = Window.partitionBy("band", "salt")
    marked = keys.withColumn("first", F.min("h").over(within)).withColumn("last", F.max("h").over(within))
    members = cut(marked.where("first <> last OR salt > 0").select("band", "h", "first", "salt"))
    if some_hot:
        heads = members.where("salt > 0 AND h = first").select("band", "h")
        least = heads.groupBy("band").agg(F.min("h").alias("first"))
        members = members.unionByName(heads.join(least, "band").where("h <> first").withColumn("salt", F.lit(0)))
    return members.select("band", "h", "first")


def joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (a, b) join components: only the roots that are linked are contracted further."""
    more = components(links, native=True)
    release(links.sparkSession)
    if roots is None:
        return more
    known = roots.join(by_key(more.select(F.col("node").alias("root"), F.col("root").alias("next"))), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(known.unionByName(more.join(by_key(roots), "node", "left_anti")))


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the components ``ra`` and ``rb`` of both ends, where these differ."""
    for k in "ab":
        pairs = pairs.join(by_key(roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}"))), k, "left")
    return pairs.withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).where("ra <> rb")


def opened_bands(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``members`` (band, h, ...) of bands with several components, with their own (``comp``), the band's commonest
    (``main``), and the numbers of lines of the band (``size``) and of those in other components (``outside``)."""
    placed = members.join(by_key(roots.withColumnRenamed("node", "h")), "h", "left").withColumn("comp", F.coalesce("root", "h")).drop("root")
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside"))
    return placed.join(by_key(main.where("outside > 0")), "band")


def pivots_of(opened: DataFrame, pivots: int) -> DataFrame:
    """The lines (h, band, comp) of each band that share most with others: one of all, or ``pivots`` of other components than ``main``."""
    dealt = opened.withColumn("k", F.lit(0)) if pivots == 1 else opened.where("comp <> main").withColumn("k", F.pmod(F.xxhash64("comp"), F.lit(pivots)))
    return dealt.groupBy("band", "k").agg(F.max(F.struct("shared", "h", "comp")).alias("head")).select("head.h", "band", "head.comp")


def crossing_pairs(some: DataFrame, opened: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines of ``some`` and ``opened`` (h, band, comp), of one band and two components, that may be like."""

    def side(rows: DataFrame, k: str) -> DataFrame:
        told = rows.select("h", "band", "comp").join(by_key(texts.select("h", "n", "sketch")), "h")
        return told.select("band", *[F.col(c).alias(f"{c}_{k}") for c in ("h", "comp", "n", "sketch")])

    pairs = side(some, "x").join(by_key(side(opened, "y")), "band").where((F.col("comp_x") != F.col("comp_y")) & may_be_like("x", "y", similarity))
    return pairs.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()


def line_components(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) for every line hash that has a link: the components of links of at least ``similarity``."""
    lines = lines_of(documents).withColumn("h", F.xxhash64("line"))
    # Grouped by the bands too, which follow from the line: so copies combine before the shuffle.
    signatures = signed(lines).select("h", bands().alias("bands")).distinct()
    signatures = cut(signatures)
    release(documents.sparkSession)  # the files of its shuffle go before the bands are dealt
    members = band_members(signatures)
    del signatures
    release(documents.sparkSession)
    needed = cut(members.select("h").distinct())
    few = needed.count() <= BROADCAST_ROWS
    texts = lines.select("h", "line").join(F.broadcast(needed) if few else needed, "h", "left_semi").distinct()
    hashed = by_class(texts.withColumn("s", F.sort_array(F.array_distinct(shingle_hashes(F.col("line"))))))
    texts = cut(hashed.select("h", "line", F.size("s").alias("n"), sketch().alias("sketch")))
    release(documents.sparkSession)
    stars = members.where("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b")).distinct()
    roots = joined_roots(None, verified(stars, texts, similarity))
    opened = cut(opened_bands(members.select("band", "h"), roots).withColumn("shared", F.sum("size").over(Window.partitionBy("h"))))
    for pivots in PIVOTS:
        wide = opened.where(F.col("outside") > F.lit(WIDE))
        if wide.isEmpty():
            break
        linked = verified(crossing_pairs(pivots_of(wide, pivots), wide, texts, similarity), texts, similarity)
        roots = joined_roots(roots, rooted(linked, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        opened = cut(opened_bands(opened.select("band", "h", "shared"), roots))
        release(documents.sparkSession)
    last = verified(crossing_pairs(opened.where("comp <> main"), opened, texts, similarity), texts, similarity)
    return joined_roots(roots, rooted(last, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def dedup_lines(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line with a word: doc_id, line_no, the first place of its component, and whether it is kept."""
    roots = line_components(documents, similarity)
    own = cut(lines_of(documents).select("doc_id", "line_no", F.xxhash64("line").alias("h")))
    firsts = own.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("place"))
    placed = firsts.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "place", F.coalesce("root", "h").alias("root"))
    best = placed.groupBy("root").agg(F.min("place").alias("first"))
    by_line = placed.join(best, "root").select("h", "first")
    joined = own.join(by_line, "h")
    return joined.select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
                         (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"))


def without_duplicate_lines(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, their texts without the lines that are not kept. Null texts stay null."""
    name, key = free_name(documents, "gone"), free_name(documents, "gone_id")
    gone = dedup_lines(documents, similarity).where("NOT kept").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(name))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(name, i))
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return documents.join(gone, F.col("doc_id").eqNullSafe(F.col(key)), "left").withColumn("text", text).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs of lines that share shingles, and the closure of those that are like enough.
SQL = """WITH RECURSIVE l AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INT) AS line_no, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 n AS (SELECT doc_id, line_no, trim(lower(raw), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
 u AS (SELECT line, row_number() OVER (ORDER BY line) AS id, min((doc_id, line_no)) AS first FROM n GROUP BY line),
 g AS (SELECT DISTINCT id, substr(line, i, 7) AS sh FROM (SELECT id, line, unnest(range(1, greatest(2, length(line) - 5))) AS i FROM u)),
 c AS (SELECT id, count(*) AS n FROM g GROUP BY id),
 p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM g a JOIN g b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE k >= 0.8 * (a.n + b.n - k) UNION ALL SELECT y, x FROM p JOIN c a ON a.id = x JOIN c b ON b.id = y WHERE k >= 0.8 * (a.n + b.n - k)),
 r(id, root) AS (SELECT id, id FROM u UNION SELECT e.y, r.root FROM r JOIN e ON r.id = e.x),
 q AS (SELECT id, min(root) AS root FROM r GROUP BY id), f AS (SELECT root, min(first) AS first FROM q JOIN u USING (id) GROUP BY root)
 SELECT n.doc_id, n.line_no, f.first[1] AS first_doc_id, f.first[2] AS first_line_no, n.doc_id = f.first[1] AND n.line_no = f.first[2] AS kept FROM n JOIN u USING (line) JOIN q USING (id) JOIN f USING (root)"""
