"""Fuzzy line dedup by MinHash, in DataFrame and SQL functions only.

Two lines are copies if the sets of their runs of ``SHINGLE`` characters have a Jaccard similarity of
``SIMILARITY`` at least. Candidates come from MinHash signatures of *bands* of neighbouring shingles: a
band of 20 shingles is a run of ``LONG`` characters, one of 12 a run of ``WIDE``, one of 4 a run of ``NARROW``.
Every band of a line is hashed; the hashes below a bound are its signature, and each of them is a key under which
lines meet. The bound is such that ``EXPECTED`` bands of a kind of a line lie below it. Bounds are nested, so a hash
that two copies share and that is below the smaller bound is a key of both. Lines of ``SHORT`` characters at
most have all their narrow bands as keys, those from ``MIDDLE`` to ``BOTH`` characters wide ones, those from
``ALONE`` on long ones: two copies on either side of an edge share a kind.

Where edits are as many as SIMILARITY lets them be (one in 45 characters, at random places), two lines share about
0.54 of their wide bands and 0.42 of their long ones: by calculation 0.02 % of such pairs have no wide key in common,
0.09 % of those that only have long ones no long key; the more alike, the fewer.

A key's rows are sorted once, which gives its smallest line; the others meet that (a star). Where more than ``CROWD``
lines would then be held against each line of a key in another component, the key's lines meet ``TURNS`` others first,
which links groups of copies in linear time. All
lines of a key that are then still in different components meet each other inside a join on the key,
whose condition compares sketches (see ``may_reach``; no pair at SIMILARITY is lost) and lets a pair out under the
smallest key that it shares only: each likely pair leaves it once. Keys of over ``LARGE`` lines are joined in blocks,
each with each: whether two lines meet doesn't depend on how many others share their key. Every likely pair is
verified by exact Jaccard similarity, and
union-find keeps one line of each component: the first by (doc_id, text hash, line number).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fading, written
from .components import connected_components

#: Characters of a shingle, and the similarity from which two lines are copies.
SHINGLE = 5
SIMILARITY = 0.8

#: Bands of a line that are in its signature, on average.
EXPECTED = 12
#: Characters (UTF-16 units) of the three kinds of bands, and of the lines that have them.
LONG, WIDE, NARROW = 24, 16, 8
SHORT, MIDDLE, ALONE, BOTH = 48, 36, 128, 170
#: 64-bit words of the bit set that tells most unlike lines apart (lines that differ in over 2,000 shingles look alike to it).
WORDS = 16
#: Lines of a key that are held against each other in one task, about; those of larger keys meet in blocks.
LARGE = 1 << 14
#: Lines of a key that the others meet, beside the smallest, before all meet each other.
TURNS = 2
#: Lines that a line is held against under each of its keys, on average, from which such meetings are worth their while.
CROWD = 256
#: Likely pairs for each line from which each line's nearest partner is verified before the others.
MANY_PAIRS = 2
#: Links (16 bytes each) that are joined to components in the driver.
HERE = 1 << 18
#: Lines of which each makes up over one part in so many of all lines are joined by broadcast.
HOT_PARTS = 4096
#: Most bits of a filter (it is broadcast: 16 bytes for 64 bits); a fuller one lets more through.
MOST_BITS = 1 << 26


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, line): every line, from 0, cut at line feeds. mark is a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def has_word() -> Column:
    return F.col("line").rlike(r"[^\x20\x09-\x0D]")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A run of what rulers are drawn with, longer than a shingle.
RULER = r"([-=_*#.~+ ])\1{5}"


def flattened(line: Column) -> Column:
    """A line whose runs of one of a ruler's characters are five long at most: its set of shingles is the same."""
    return F.when(line.rlike(RULER), F.regexp_replace(line, RULER[:-3] + "{5,}+", "$1$1$1$1$1")).otherwise(line)


def below(key: Column, n: Column) -> Column:
    """Whether a hash is below the bound of a line with ``n`` bands."""
    return key.bitwiseAND((1 << 40) - 1) * F.least(n, F.lit(1 << 22)) < EXPECTED * (1 << 40)


def spot() -> Column:
    """A hash of a line's place."""
    return F.xxhash64("doc_id", "mark", "line_no").alias("spot")


def line_keys(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, key, alone) of each line that holds a word, a row for each of its keys; id is a hash of the line.

    ``hot`` has id and first, the spot of a line that occurs often (it is broadcast): the others of its kind are left out.
    """
    lines = split_lines(docs).where(has_word()).select(spot(), F.xxhash64("line").alias("id"), "line").join(F.broadcast(hot), "id", "left").where("first IS NULL OR first = spot")
    sized = lines.select("id", F.encode(flattened(F.col("line")), "UTF-16BE").alias("units")).select("*", F.expr("octet_length(units) DIV 2").alias("n"))
    n, at = F.col("n"), F.col("at")
    counts = [F.when(n <= SHORT, F.greatest(n - (NARROW - 1), F.lit(1))).otherwise(0), F.when(n.between(MIDDLE, BOTH), n - (WIDE - 1)).otherwise(0), F.when(n >= ALONE, n - (LONG - 1)).otherwise(0)]
    sized = sized.select("*", *[c.alias(k) for k, c in zip(("narrows", "wides", "longs"), counts, strict=True)])
    # Up to 0 the narrow bands, then the wide ones, then the long ones.
    placed = sized.select("id", "units", "wides", "longs", F.explode(F.expr("sequence(1 - narrows, wides + longs, 1)")).alias("at"))
    kind = lambda narrow, wide, long: F.when(at > F.col("wides"), long).when(at > 0, wide).otherwise(narrow)
    start, size = kind(1 - 2 * at, 2 * at - 1, 2 * (at - F.col("wides")) - 1), kind(F.lit(2 * NARROW), F.lit(2 * WIDE), F.lit(2 * LONG))
    key = F.xxhash64(kind(F.lit(3), F.lit(2), F.lit(4)), F.substring(F.col("units"), start, size))
    return placed.select("id", "at", "wides", "longs", key.alias("key")).where((at <= 0) | below(F.col("key"), F.when(at > F.col("wides"), F.col("longs")).otherwise(F.col("wides")))).select("id", "key", F.lit(True).alias("alone"))


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two arrays of different shingles."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def shingles(line: Column) -> Column:
    """All different runs of SHINGLE characters, as 64-bit hashes (sets of those are much cheaper than
    sets of strings); a shorter line is one shingle."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(line) - (SHINGLE - 1), F.lit(1)))
    runs = lambda units: F.transform(places, lambda i: F.xxhash64(F.substring(units, 4 * i - 3, F.lit(4 * SHINGLE))))  # noqa: E731  four bytes a character
    return F.array_distinct(let(F.encode(line, "UTF-32"), runs))


def probable(df: DataFrame, key: str, wanted: DataFrame, count: int) -> DataFrame:
    """``df`` with ``hit``: whether its ``key`` may be among ``wanted``'s; true for all that are.

    A bit set of 16 bits for each of the ``count`` wanted keys, MOST_BITS at most, is broadcast.
    """
    bits = min(MOST_BITS, 1 << max(12, (16 * count).bit_length()))
    slot = f"pmod(xxhash64(7, `{key}`), {bits}L)"
    words = wanted.selectExpr(f"{slot} DIV 64 AS filter_word", f"shiftleft(1L, CAST({slot} % 64 AS INT)) AS filter_bit").groupBy("filter_word").agg(F.bit_or("filter_bit").alias("filter_bits"))
    held = df.withColumn("filter_slot", F.expr(slot)).withColumn("filter_word", F.expr("filter_slot DIV 64")).join(F.broadcast(words), "filter_word", "left")
    return held.select(*df.columns, F.expr("coalesce(getbit(filter_bits, CAST(filter_slot % 64 AS INT)) = 1, false)").alias("hit"))


def filtered(df: DataFrame, key: str, wanted: DataFrame, count: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``wanted``'s: none of those is missing."""
    return probable(df, key, wanted, count).where("hit").drop("hit")


def sketched(texts: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """(id, p, w0 ...) of each (id, line): p is the number of a line's different shingles (``of`` gives them); the words are
    a bit set in which each of them flips one bit.

    Two such sets differ as the set of the shingles that only one line has would: they don't fill up with
    the lines' length, as sets in which bits are only put would.
    """
    sets = texts.select("id", "line").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").select("id", of(F.col("line")).alias("set"))
    hashes = sets.select("id", F.size("set").alias("p"), F.explode_outer("set").alias("hash"))  # a plain one would work out the sets twice, to leave out empty ones; there are none
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("hash", 8).bitwiseAND(63).cast("int"))
    words = hashes.groupBy("id", "p", F.col("hash").bitwiseAND(WORDS - 1).cast("int").alias("word")).agg(F.bit_xor(bit).alias("bits"))
    return words.groupBy("id").agg(F.max("p").alias("p"), *[F.coalesce(F.max(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)])


def apart(x: str, y: str) -> Column:
    """Bits that two sketches (columns that end with ``x`` and ``y``) differ in."""
    return sum((F.bit_count(F.col(f"w{i}{x}").bitwiseXOR(F.col(f"w{i}{y}"))) for i in range(WORDS)), F.lit(0))


def _room(least: Column, both: Column) -> Column:
    """Whether sets of ``both`` shingles together that differ in ``least`` at least may reach SIMILARITY."""
    return least * (1 + SIMILARITY) / (1 - SIMILARITY) <= both + 1e-6


def may_reach(x: str, y: str) -> Column:
    """Whether two sketches (columns that end with ``x`` and ``y``) leave room for SIMILARITY.

    No pair is missed: sets of n and m shingles that reach 0.8 differ in (n + m) / 9 shingles at most;
    they differ in |n - m| at least, and their bit sets in no more bits than they in shingles.
    """
    n, m = F.col(f"p{x}"), F.col(f"p{y}")
    return _room(F.abs(n - m), n + m) & _room(apart(x, y), n + m)


def _verified(pairs: DataFrame, texts: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """The pairs (x, y, a written table) of line ids whose lines reach SIMILARITY."""
    wanted = filtered(texts, "id", pairs.select(F.explode(F.array("x", "y")).alias("id")), 2 * pairs.count())  # few lines are shuffled
    side = lambda x, t: wanted.select(F.col("id").alias(x), F.col("line").alias(t))
    both = pairs.select("x", "y").join(side("x", "lx"), "x").join(side("y", "ly"), "y")
    sets = F.struct(of(F.col("lx")).alias("a"), of(F.col("ly")).alias("b"))
    return both.where(let(sets, lambda s: jaccard(s["a"], s["b"]) >= SIMILARITY)).select("x", "y")


def fuzzy_components(bands: DataFrame, found: Callable[[DataFrame, int], DataFrame], of: Callable[[Column], Column] = shingles) -> DataFrame:
    """(id, check, component) of the lines that are linked to another line.

    ``bands`` has id (a hash of the line), key and alone, any number of times, and is read once; ``found(ids, count)`` gives id,
    check (a second hash) and line of the lines with those ids, any number of times; ``of`` gives a line's
    shingles. Of lines that share an id by accident one takes part.
    """
    with fading("fuzzy"):
        of_key = Window.partitionBy("key")
        shared = bands.select("id", "key", "alone", F.min("id").over(of_key).alias("lo"), F.max("id").over(of_key).alias("hi")).where("lo != hi")  # groups of copies are one id
        every = written(shared.groupBy("key", "id", "lo").agg(F.max("alone").alias("alone")), "members")
        # Lines at SIMILARITY share two keys or more; those that are alone may have no second.
        ids = written(every.groupBy("id").agg(F.count("*").alias("keys"), F.max("alone").alias("alone")).where("alone OR keys > 1").select("id"), "ids")
        count = ids.count()
        least = F.min(F.struct("check", "line")).alias("s")
        texts = written(found(ids, count).join(ids, "id", "left_semi").groupBy("id").agg(least).select("id", "s.*"), "texts")
        known = written(sketched(texts, of), "sketches")
        # Stars: the lines of a key meet its smallest line.
        others = every.where("id != lo")
        likely = written(_likely(others.select(F.col("lo").alias("x"), F.col("id").alias("y")).distinct(), known), "stars")
        parts = written(_joined(None, written(_verified(likely, texts, of), "edges")), "parts")
        rows = written(_mixed(others.select("key", "id").join(known.select("id", "p"), "id"), parts), "open")
        discard(every)
        for turn in range(TURNS):
            meetings, lines = rows.agg(F.sum("many"), F.count("*")).first()
            if (meetings or 0) <= CROWD * lines:
                break
            # The lines of a key that are in other components than one of them meet that one.
            lead = rows.groupBy("key").agg(F.min_by(F.struct("id", "component", "p"), F.xxhash64(F.lit(turn), "id")).alias("lead"))
            met = rows.join(lead, "key").where("component != lead.component").where(_room(F.abs(F.col("p") - F.col("lead.p")), F.col("p") + F.col("lead.p")))
            ends = met.select(F.least("id", "lead.id").alias("x"), F.greatest("id", "lead.id").alias("y")).distinct()
            more = written(_likely(ends, known).join(likely, ["x", "y"], "left_anti"), "stars")
            parts = written(_joined(parts, written(_verified(more, texts, of), "edges")), "parts")
            likely, before = likely.unionByName(more), rows
            rows = written(_mixed(before, parts), "open")
            discard(before)
        # Across: the lines of a key that are still in different components meet each other.
        wide = rows.join(known.drop("p").join(rows.groupBy("id").agg(F.collect_list("key").alias("keys")), "id"), "id")
        pairs = _across(wide.where(F.col("many") <= LARGE))
        if (rows.agg(F.max("many")).first()[0] or 0) > LARGE:
            pairs = pairs.unionByName(_across(wide.where(F.col("many") > LARGE), True))
        rest = new = written(pairs.join(likely, ["x", "y"], "left_anti"), "across")
        discard(rows)
        if new.count() > MANY_PAIRS * count:
            # Each line's nearest partner first; then the pairs that this leaves in different components.
            end = F.struct("apart", "x", "y").alias("pair")
            nearest = new.select(F.col("x").alias("id"), end).union(new.select(F.col("y").alias("id"), end)).groupBy("id").agg(F.min("pair").alias("pair"))
            nearest = written(nearest.select("pair.x", "pair.y").distinct(), "nearest")
            parts = written(_joined(parts, written(_verified(nearest, texts, of), "first")), "parts")
            rest = written(_placed(new.join(nearest, ["x", "y"], "left_anti"), parts).where("cx != cy"), "rest")
        more = written(_verified(rest, texts, of), "more")
        return written(_joined(parts, more).join(texts.select("id", "check"), "id").select("id", "check", "component"), "fuzzy")


def _likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sketches leave room for SIMILARITY."""
    renamed = lambda x: known.select(*[F.col(c).alias(c + x) for c in known.columns])
    met = pairs.join(renamed("_x"), F.col("x") == F.col("id_x")).join(renamed("_y"), F.col("y") == F.col("id_y"))
    return met.where(may_reach("_x", "_y")).select("x", "y")


def _placed(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(x, y) with cx and cy, their components: a line that has no link yet is its own."""
    part = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias("c" + x))
    return pairs.join(part("x"), "x", "left").join(part("y"), "y", "left").select("x", "y", F.coalesce("cx", "x").alias("cx"), F.coalesce("cy", "y").alias("cy"))


def _joined(parts: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(id, component) of all lines of ``parts`` and ``edges`` (x, y), with the components that edges join as one."""
    if parts is None:
        return connected_components(edges, here=HERE).withColumnRenamed("node", "id")
    whole = connected_components(_placed(edges, parts).select("cx", "cy"), here=HERE).select(F.col("node").alias("component"), F.col("component").alias("better"))
    ends = edges.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    # A line that only ``edges`` has is its own component; for one in ``parts`` too, that one is the smaller.
    nodes = parts.select("id", "component").union(ends.select("id", F.col("id").alias("component")))
    return nodes.join(whole, "component", "left").select("id", F.coalesce("better", "component").alias("component")).groupBy("id").agg(F.min("component").alias("component"))


def _mixed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, many, id, p, component) of the keys whose lines are in several components; many: how many they are."""
    placed = rows.select("key", "id", "p").join(parts, "id", "left").select("key", "id", "p", F.coalesce("component", "id").alias("component"))
    of_key = Window.partitionBy("key")
    spread = placed.select("*", F.min("component").over(of_key).alias("first"), F.max("component").over(of_key).alias("last"), F.count("*").over(of_key).alias("many"))
    return spread.where("first != last").select("key", "many", "id", "p", "component")


def _across(rows: DataFrame, blocks: bool = False) -> DataFrame:
    """The likely pairs (x, y, apart) of lines of different components that share a key; apart is the
    share of their shingles that their sketches differ in.

    Sketches are compared inside the join, so that only likely pairs leave it, each under the smallest of the ``keys`` that
    both of its lines have: under none of the smaller ones. Both sides of the join are one shuffle of the rows, and its
    condition is short enough for the JVM's compiler: keep both so. With ``blocks``, a key's lines are dealt to blocks of
    about LARGE, and each block meets each: every pair once.
    """
    names = ["id", "component", "p", *[f"w{i}" for i in range(WORDS)]]
    # No value is null; said so, the condition is shorter.
    side = lambda x, *more: rows.select("key", *more, F.expr("filter(keys, k -> k < key)").alias("less" + x), *[F.coalesce(F.col(c), F.lit(0)).alias(c + x) for c in names])
    if blocks:
        count = F.ceil(F.col("many") / LARGE)
        own, other = F.pmod(F.xxhash64(F.lit(8), "id"), count), F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
        met = side("_x", own.alias("left"), other.alias("right")).join(side("_y", own.alias("right"), other.alias("left")), ["key", "left", "right"])
    else:
        met = side("_x").join(side("_y"), "key")
    met = met.where(F.col("component_x") < F.col("component_y")).where(may_reach("_x", "_y")).where(~F.arrays_overlap("less_x", "less_y"))
    return met.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y"), (apart("_x", "_y") / (F.col("p_x") + F.col("p_y"))).alias("apart"))


def line_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no) of every line that goes.

    A line goes if it isn't the first of its component, or of its equals: the smallest (doc_id, mark,
    line number), a null doc_id before all others. Lines without a word take no part and always stay.
    """
    whole = split_lines(docs).where(has_word()).select("doc_id", "mark", "line_no", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("check"))
    lines = written(whole, "places")
    place = F.struct("doc_id", "mark", "line_no")
    groups = written(lines.groupBy("id", "check").agg(F.min(place).alias("first"), F.count("*").alias("many")), "groups")
    total = groups.agg(F.sum("many")).first()[0] or 0
    often = groups.where(F.col("many") > total / HOT_PARTS)  # HOT_PARTS rows at most
    hot = often.groupBy("id").agg(F.min("first").alias("first")).select("id", F.xxhash64("first.doc_id", "first.mark", "first.line_no").alias("first"))

    def found(ids: DataFrame, count: int) -> DataFrame:
        """Each wanted line once: where it first occurs."""
        where = groups.join(ids, "id", "left_semi").select("id", "check", F.xxhash64("first.doc_id", "first.mark", "first.line_no").alias("spot"))
        here = split_lines(docs).where(has_word()).select(spot(), "line")
        return filtered(here, "spot", where, count).select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), F.col("line")).alias("check"), "line")

    parts = fuzzy_components(line_keys(docs, hot), found)
    linked = groups.join(parts, ["id", "check"])
    firsts = linked.groupBy("component").agg(F.min("first").alias("head"))
    better = linked.join(firsts, "component").select("id", "check", "head")
    # Only lines that aren't the one occurrence of their group can go.
    named = groups.join(better, ["id", "check"], "left").select("id", "check", "many", "first", F.coalesce("head", "first").alias("head")).where("many > 1 OR head != first").drop("first")
    named = written(named, "named")
    discard(groups)
    discard(parts)
    hot = named.where(F.col("many") > total / HOT_PARTS)  # HOT_PARTS rows at most
    rare = named.where(F.col("many") <= total / HOT_PARTS)
    narrow = lines.select(place.alias("place"), "id", "check")
    gone = narrow.join(F.broadcast(hot), ["id", "check"]).unionByName(narrow.join(F.broadcast(hot.select("id", "check")), ["id", "check"], "left_anti").join(rare, ["id", "check"]))
    return gone.where(~F.col("place").eqNullSafe(F.col("head"))).select("place.*")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with each text without the lines that repeat an earlier one; all columns, all rows.

    Lines are copies if their character shingles reach SIMILARITY or if a chain of such lines joins
    them; of each component the line with the smallest (doc_id, text hash, line number) stays. Lines
    without a word always stay. A null text stays null, an empty one empty; a document whose lines all
    go has an empty text. Rows that repeat both doc_id and text count as one document and lose the same
    lines; rows that only share a doc_id are documents of their own. A null doc_id comes first in order.
    An empty table gives an empty one. Other columns stay, whatever their names.
    """
    with fading("drops"):
        drops = line_verdicts(docs).groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("drop_lines"))  # a document's own lines
        drops = written(drops.select(F.xxhash64("doc_id", "mark").alias("spot"), "doc_id", "mark", "drop_lines"), "drops")
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("row_doc"), F.xxhash64(text).alias("row_mark"))
    rows = rows.select("row", "row_doc", "row_mark", F.xxhash64("row_doc", "row_mark").alias("spot"))
    judged = probable(rows, "spot", drops, drops.count())
    same = F.col("row_doc").eqNullSafe(F.col("doc_id")) & (F.col("row_mark") == F.col("mark"))
    changed = judged.where("hit").join(drops.withColumnRenamed("spot", "drop_spot"), (F.col("spot") == F.col("drop_spot")) & same, "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains(F.col("drop_lines"), i))
    text = F.when(F.col("drop_lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    whole = [F.col(f"row.`{c}`") for c in names]
    return judged.where("NOT hit").select(whole).unionByName(changed.select(*[text.alias(c) if c == "text" else x for c, x in zip(names, whole, strict=True)]))
