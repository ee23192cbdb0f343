"""Line dedup by a suffix array over line IDs: prefix doubling in DataFrame functions alone.

Every line is an ID (two 64-bit hashes), every document a sequence of them, every line the start of a suffix. Suffixes are
ranked by their first line, then by the first 2, 4, ... lines: the pair of ranks (here, h lines on) is grouped, distinct
pairs are sorted, and their order gives the ranks of twice the depth. Suffixes that share a rank at depth h are an
interval of the suffix array whose longest common prefix is h lines or more, that is, a repeated run; suffixes alone in
their interval leave at once. Doubling goes on until no interval is left.

The intervals of depth h and 2 h say only that some suffixes share between h and 2 h lines. How many exactly comes from
going down again: in each interval of depth h one suffix stands for each interval of depth 2 h inside it, and those are
told apart by the ranks of h / 2, h / 4, ..., 1 further lines. At the end all suffixes of a group share exactly its depth,
a node of the suffix tree, and each of them but the first, by document and line, is named once: its longest run that has
an earlier copy. Runs of min_chars characters that no run before them covers are the maximal ones, and go.

Documents with such lines are numbered in their order, and a suffix is one number, document and line, so that the first of
an interval is a plain minimum, summed by hashing. Only (place, rank) is shuffled here, and pairs are pre-aggregated before they
are, so a line of very many copies weighs little; ranks go back by an equi-join that Spark can split. Texts are shuffled once at most,
to meet the numbers of their dropped lines. Tables of a round are deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, document_key, few, forget, hashes

#: A later copy of a run of lines goes if it has so many characters, line breaks between its lines counted.
MIN_CHARS = 30
#: What names a line: its document and its number.
HERE = ("none", "doc", "mark", "i")
#: Bits of a line's place: its document's number and its own, in one long.
PLACE_BITS = 62


def lines(docs: DataFrame) -> DataFrame:
    """(none, doc, mark, i, id, more, chars) of each line; a null text has none, an empty one has one, of 0 characters."""
    none, doc, mark = document_key(F.col("doc_id"), F.col("text"))
    split = docs.where("text is not null").select(none.alias("none"), doc.alias("doc"), mark.alias("mark"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    one, two = hashes(F.col("line"))
    return split.select(*HERE, one.alias("id"), two.alias("more"), F.length("line").cast("long").alias("chars"))


def intervals(suffixes: DataFrame, *key: str) -> DataFrame:
    """(key..., copies, first, next) of each interval of two suffixes (p) or more; ranks (next) follow the order of the keys."""
    many = suffixes.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("p").alias("first")).where("copies > 1")
    return cut(many.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("next", F.monotonically_increasing_id()))


def numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """(none, doc, mark, d) of documents (none, doc, mark), d from 0 without gaps, in their order; and how many they are. The
    numbers of rows in partitions, one for each, make partitions' own numbers into one row of numbers."""
    own = cut(names.distinct().repartitionByRange("none", "doc", "mark").sortWithinPartitions("none", "doc", "mark").withColumn("k", F.monotonically_increasing_id()))
    part, inside = F.shiftright("k", 33), F.col("k").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    out = cut(own.withColumn("part", part).join(F.broadcast(before), "part").select("none", "doc", "mark", (F.col("low") + inside).alias("d")))  # a row for each partition
    forget(own)
    return out, out.count()


class Places:
    """Suffixes by their places: p = d << bits | i, for line i of document d of those that have a line that is somewhere else, too. One
    number orders them, names their document, and has the line h lines on at p + h."""

    def __init__(self, docs: DataFrame):
        every = lines(docs)
        found = cut(every.groupBy("id", "more").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
        held = cut(every.join(found, ["id", "more"]).select(*HERE, "id", "more", "chars"))
        self.names, n = numbered(held.select("none", "doc", "mark"))
        self.bits = int(held.agg(F.max("i")).first()[0] or 0).bit_length() or 1
        if n.bit_length() + self.bits > PLACE_BITS:
            raise ValueError(f"{n} documents of up to {1 << self.bits} lines are more than {PLACE_BITS} bits can number")
        place = F.shiftleft("d", self.bits).bitwiseOR(F.col("i").cast("long"))
        # A document that is there twice has each line twice up to here.
        self.rows = cut(held.join(self.names, ["none", "doc", "mark"]).select(place.alias("p"), "id", "more", "chars").distinct())
        forget(found, held)

    def document(self, p: str = "p"):
        return F.shiftright(p, self.bits)

    def named(self, table: DataFrame) -> DataFrame:
        """table with none, doc, mark and i in place of p."""
        lines_ = table.withColumns({"d": self.document(), "i": F.col("p").bitwiseAND((1 << self.bits) - 1).cast("int")}).drop("p")
        return lines_.join(self.names, "d").select(*HERE, *[c for c in table.columns if c != "p"])


def levels(docs: DataFrame, depth: int | None = None):
    """Yields (h, table) for h = 1, 2, 4, ... until no interval is left, or up to depth. A table has the suffixes in
    intervals of h shared lines: none, doc, mark, i, chars (of the h lines), n and rank (of the interval); next_chars,
    next_n and next (of the one of 2 h lines; null if there is none) and stands (whether the suffix stands for it, or for
    itself, among others of its interval)."""
    places = Places(docs)
    for h, table in levels_of(places, depth):
        yield h, places.named(table)


def levels_of(places: Places, depth: int | None = None):
    """levels() by places: p instead of none, doc, mark and i."""
    found = intervals(places.rows, "id", "more")
    if found.isEmpty():
        forget(found, places.rows)
        return
    level, h = places.rows.join(found, ["id", "more"]).select("p", "chars", F.col("copies").alias("n"), F.col("next").alias("rank")), 1
    old = [found, places.rows]
    while True:
        after = F.max(F.struct("rank", "chars")).over(Window.partitionBy(places.document()).orderBy("p").rangeBetween(h, h))
        pairs = cut(level.withColumn("after", after).select("p", "chars", "n", "rank", F.col("after.rank").alias("then"), (F.col("chars") + F.lit(1) + F.col("after.chars")).alias("next_chars")))
        found = intervals(pairs.where("then is not null"), "rank", "then")
        last = found.isEmpty()
        joined = pairs.join(found, ["rank", "then"], "left")
        alone = F.col("next").isNull()
        stands = alone | (F.col("p") == F.col("first")) & (F.col("copies") < F.col("n"))
        level = cut(joined.select("p", "chars", "n", "rank", F.when(~alone, F.col("next_chars")).alias("next_chars"), F.col("copies").alias("next_n"), "next", stands.alias("stands")))
        forget(pairs, found, *old)
        old = []
        yield h, level
        if last or depth is not None and h >= depth:
            return
        level = level.where("next is not null").select("p", F.col("next_chars").alias("chars"), F.col("next_n").alias("n"), F.col("next").alias("rank"))
        h *= 2


def longest_runs(places: Places) -> DataFrame | None:
    """(p, n, chars): for each line that begins a run with an earlier copy the longest such run, in lines and characters; None if
    no line is there twice."""
    tables, group = dict(levels_of(places)), None
    if not tables:
        return None
    entering = lambda h, tag: tables[h].where("stands").select("p", (F.col("rank") * 64 + F.lit(32 + tag)).alias("grp"), F.lit(h).alias("n"), "chars")
    old = []
    for tag in range(len(tables) - 1, -1, -1):
        h = 1 << tag
        if group is not None:
            step = tables[h].select(F.col("p").alias("at"), F.col("rank").alias("then"), F.col("chars").alias("more"))
            # A place behind a document's last line is no line of the next one's: numbers of lines don't fill their bits.
            inside = F.when(places.document("at") == places.document(), F.col("at"))
            known = cut(group.withColumn("at", F.col("p") + F.col("n")).withColumn("at", inside).join(step, "at", "left").drop("at"))
            forget(*old)
            shared = known.where("then is not null").groupBy("grp", "then").agg(F.count(F.lit(1)).alias("copies"), F.min("p").alias("first")).where("copies > 1")
            shared = cut(shared.withColumn("into", F.monotonically_increasing_id() * 64 + F.lit(tag)).drop("copies"))
            both = known.join(shared, ["grp", "then"], "left")
            deeper = F.struct(F.col("into").alias("grp"), (F.col("n") + h).alias("n"), (F.col("chars") + F.lit(1) + F.col("more")).alias("chars"))
            stays = F.when(F.col("into").isNull() | (F.col("p") == F.col("first")), F.struct("grp", "n", "chars"))
            group = both.select("p", F.inline(F.array_compact(F.array(F.when(F.col("into").isNotNull(), deeper), stays))))
            old = [known, shared]
        fresh = entering(h, tag)
        group = fresh if group is None else group.union(fresh)
    group = cut(group)
    forget(*old, *tables.values())
    first = cut(group.groupBy("grp").agg(F.count(F.lit(1)).alias("copies"), F.min("p").alias("first")).where("copies > 1").drop("copies"))
    return group.join(few(first), "grp").where(F.col("p") > F.col("first")).select("p", "n", "chars")


def maximal_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(none, doc, mark, i, n, chars, done): runs of min_chars or more with an earlier copy that no such run before
    them covers; done: where the one before ends, which may be behind i."""
    places = Places(docs)
    found = longest_runs(places)
    if found is None:
        return lines(docs).select(*HERE, F.lit(1).alias("n"), "chars", F.lit(0).alias("done")).limit(0)
    runs = places.named(found.where(F.col("chars") >= min_chars))
    before = Window.partitionBy("none", "doc", "mark").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("done", F.coalesce(F.max(F.col("i") + F.col("n")).over(before), F.lit(0))).where("i + n > done")


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(none, doc, mark, gone, runs): the numbers of the lines that go, in order, and how many maximal runs they are, for each
    document that loses some."""
    part = F.struct(F.greatest("i", "done").alias("a"), (F.col("i") + F.col("n") - 1).alias("b"))
    parts = maximal_runs(docs, min_chars).groupBy("none", "doc", "mark").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    gone = F.flatten(F.transform("parts", lambda p: F.sequence(p["a"], p["b"])))
    return parts.select("none", "doc", "mark", gone.alias("gone"), F.size("parts").alias("runs"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, report: bool = False) -> DataFrame:
    """docs without later copies of repeated line runs of any number of lines; n_chars, if there, follows the text. report:
    adds n_lines, n_dropped, n_runs (stretches of dropped lines) and n_maximal (maximal repeated runs, which may overlap).

    The first copy is that of the smallest doc_id (null ids last, by hashes of their texts), then text hash, then line.
    Rows that repeat a doc_id and its text are one document and share its outcome; they don't make each other's lines copies. A null text stays
    null; an empty text, or one all of whose lines go, is empty. All rows stay; no rows give no rows. Names in docs may be any. A text
    of any length is taken whole; its lines are rows, and it is one value where it meets the numbers of those that go.
    """
    # Rows travel as one struct, so that no name in docs meets one of ours.
    gone = dropped(docs, min_chars)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    old = F.col("d").getField("text")
    none, doc, mark = document_key(F.col("d.doc_id"), old)
    both = rows.join(gone, (none == gone.none) & (doc == gone.doc) & (mark == gone.mark), "left").select("d", "gone", "runs")
    # Inlined arrays of one bind a text's lines, and its new text, to names: an expression within a lambda, or used twice,
    # would be worked out anew each time.
    untouched = F.col("gone").isNull()
    bound = both.select("d", "gone", "runs", F.inline(F.array(F.struct(F.when(~untouched, F.split(old, "\n")).alias("parts")))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))  # by hashing
    text = F.when(untouched, old).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("parts", i + 1)), "\n"))
    made = bound.select("d", "gone", "runs", F.inline(F.array(F.struct(text.alias("text")))))
    own = {c: F.col("d").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(untouched, own["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    if report:
        heads = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))  # adjacent numbers are one run
        own["n_lines"] = F.when(old.isNull(), 0).otherwise(F.length(old) - F.length(F.replace(old, F.lit("\n"), F.lit(""))) + 1).cast("long")
        own |= {c: F.when(untouched, 0).otherwise(n).cast("long") for c, n in (("n_dropped", F.size("gone")), ("n_runs", heads), ("n_maximal", F.col("runs")))}
    return made.select(*[x.alias(c) for c, x in own.items()])


def op10_linededup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), report=True).drop("n_maximal")


def op10_linededup_maximal(spark, sf_dir: str) -> DataFrame:
    """(doc_id, first_line, n_lines, n_chars) of each maximal repeated run that goes, lines from 0."""
    runs = maximal_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return runs.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), F.col("i").cast("long").alias("first_line"), F.col("n").cast("long").alias("n_lines"), F.col("chars").alias("n_chars"))


#: Runs of any number of lines: the shortest parts of 30 characters, forward from each line and backward, as substrings.
OP10_SQL = r"""
WITH l AS (SELECT doc_id, i, t, sum(len(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(t) - 1 AS a, sum(len(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS z FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i AS s, i + count(*) OVER (PARTITION BY doc_id ORDER BY a RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING) - 1 AS e FROM l
UNION SELECT doc_id, i - count(*) OVER (PARTITION BY doc_id ORDER BY z RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) + 1 AS s, i AS e FROM l),
r AS (SELECT w.doc_id, s, e, substr(d.text, x.a::BIGINT + 1, (y.z - x.a)::BIGINT) AS run FROM w JOIN l x ON w.doc_id = x.doc_id AND w.s = x.i JOIN l y ON w.doc_id = y.doc_id AND w.e = y.i JOIN documents d ON w.doc_id = d.doc_id WHERE y.z - x.a >= 30),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM r) WHERE k > 1),
g AS (SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (WHERE before IS NULL OR before < i - 1) AS n_runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(t, chr(10) ORDER BY l.i) AS kept FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_runs, 0) AS n_runs
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
