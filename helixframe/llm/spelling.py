"""Grouping of spelling variants by a dictionary of pairs of trie nodes.

The words of a corpus form two tries, one read forward and one read backward. A word's place i lies between its prefix
node i and its suffix node i; leaving out the letter there leaves the pair (prefix node i, suffix node i + 1). Words of
the same such pair differ in one letter at most at that place; a word has another one and one letter more where a pair that
leaves a letter out is the pair of a place in the other. Both are equi-joins on two integers. A pair belongs to as
many words as the alphabet has letters at most, so that no key is hot, however frequent a word or its beginning is.

A node's number is worked out from its parent's number and its letter (64 bits), so that each task numbers the nodes of
its own words and equal paths have equal numbers everywhere. Two paths may share a number by chance: pairs that the join
finds are held against the words' own letters. Of a run of equal letters only the first counts as left out, so that two
words meet once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import LONG_SPAN, LOWER, cut, distinct_spans, forget, fragments, runs, spans_text, text_bytes

#: One run of so many loses a letter; shortest words, and rarest.
EVERY, MIN_CHARS, MIN_COUNT = 97, 5, 3
#: Bytes of the letters a-z and U+00C0 to U+00FF (0xC3 and one of 0x80 to 0xBF) after lower-casing A-Z, and bytes that begin
#: something else, before which a text may be cut.
LATIN = 0xC3
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[LATIN] = True
BORDER = ~LETTER[LOWER]
BORDER[0x80:0xC0] = False
#: Text that is counted at once.
COUNTED_BYTES = 4 << 20
#: A form is so many times as frequent as its variant at least.
RATIO = 2
#: What a row of nodes() stands for: a letter left out, one left out that is the first of its like, a place between letters.
SKIPPED, FIRST_SKIPPED, PLACE = 0, 1, 2
#: Words with letters left in a batch below which they are numbered one by one; rows that a task hands on at once.
FEW, ROWS = 24, 1 << 17


def crc_table() -> np.ndarray:
    """The remainders of crc32, a byte each."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crcs(begun: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, carried on from what was `begun`; all spans step side by side, long ones by themselves."""
    state, size, k = ~begun, ends - starts, 0
    live = np.flatnonzero(size <= LONG_SPAN)
    while len(live := live[size[live] > k]):
        state[live] = table[(state[live] ^ data[starts[live] + k]) & 255] ^ (state[live] >> 8)
        k += 1
    state = ~state
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]], int(begun[i]))
    return state


def word_counts(docs: DataFrame, every: int | None = EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of the letters a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased first, counted over all rows.

    every: of a run whose crc32, taken of `<doc_id>:<run>`, is divisible by this, one letter is left out, that of the crc32
    modulo its length (a null doc_id is written as nothing). Words shorter or rarer than the limits are left out. Null texts and texts
    without letters have no words; repeated rows count each; no rows give no words. Long texts are counted in parts.
    """

    def count(batches):
        table = crc_table()
        for batch in batches:
            begun = np.array([zlib.crc32(f"{x or ''}:".encode()) for x in batch.column("doc_id").to_pylist()], np.uint32)
            whole, at = text_bytes(batch.column("text"))
            for row, data, own in fragments(whole, at, BORDER, COUNTED_BYTES):
                data = LOWER[data]
                inside = LETTER[data]
                inside[1:] |= (data[1:] >> 6 == 2) & (data[:-1] == LATIN)
                starts, ends = runs(inside, own)
                heads = np.concatenate(([0], np.cumsum(data >> 6 != 2)))
                size = heads[ends] - heads[starts]
                keep = size >= min_chars
                starts, ends, size = starts[keep], ends[keep], size[keep]
                less = np.zeros(0, np.int64)
                if every is not None:
                    crc = crcs(begun[row[np.searchsorted(own, starts, "right") - 1]], data, starts, ends, table)
                    less = np.flatnonzero(crc % np.uint32(every) == 0)
                rest = np.ones(len(starts), bool)
                rest[less] = False
                found: dict[str, int] = {}
                for i in less[size[less] > min_chars].tolist():
                    run = data[starts[i] : ends[i]].tobytes().decode()
                    gone = int(crc[i]) % len(run)
                    word = run[:gone] + run[gone + 1 :]
                    found[word] = found.get(word, 0) + 1
                starts, ends = starts[rest], ends[rest]
                one, same, _ = distinct_spans(data, starts, ends)
                yield pa.RecordBatch.from_arrays([spans_text(data, starts[one], ends[one]).cast(pa.string()), pa.array(np.bincount(same, minlength=len(one)), pa.int64())], ["word", "n"])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text is not null")
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def numbered(words: DataFrame) -> DataFrame:
    """words (word, ...) with id, a long that follows the order of code points; written."""
    given = cut(words)
    out = cut(given.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()))
    forget(given)
    return out


def child(parent, letter):
    """A node's number: from its parent's and the letter between them."""
    h = (parent ^ (letter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def path(letters: np.ndarray) -> list[int]:
    """Numbers of the nodes from the root down, of one word."""
    mask, out, h = (1 << 64) - 1, [0], 0
    for x in letters.tolist():
        h = (h ^ (x + 1) * 0x9E3779B97F4A7C15 & mask) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 29) * 0x94D049BB133111EB & mask
        h ^= h >> 32
        out.append(h)
    return out


def tries(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each word's prefix nodes and suffix nodes, one more than letters for each word; all words step side by
    side, and the longest ones go on alone."""
    base = np.cumsum(sizes + 1) - (sizes + 1)
    prefix, suffix = np.zeros(int((sizes + 1).sum()), np.uint64), np.zeros(int((sizes + 1).sum()), np.uint64)
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    together = int(-falling[FEW]) if len(order) > FEW else 0
    down, up = np.zeros(len(order), np.uint64), np.zeros(len(order), np.uint64)
    for k in range(together):
        live = order[: int(np.searchsorted(falling, -k, "left"))]
        n = len(live)
        down[:n] = child(down[:n], letters[starts[live] + k])
        up[:n] = child(up[:n], letters[starts[live] + sizes[live] - 1 - k])
        prefix[base[live] + k + 1] = down[:n]
        suffix[base[live] + sizes[live] - 1 - k] = up[:n]
    for w in order[: int(np.searchsorted(falling, -together, "left"))].tolist():
        own = letters[starts[w] : starts[w] + sizes[w]]
        prefix[base[w] : base[w] + sizes[w] + 1] = path(own)
        suffix[base[w] : base[w] + sizes[w] + 1] = path(own[::-1])[::-1]
    return prefix, suffix


def nodes(words: DataFrame) -> DataFrame:
    """(p, s, id, at, kind): the pairs of trie nodes of each word (id, word): its places, and its letters left out."""

    def number(batches):
        for batch in batches:
            texts = batch.column("word").to_pylist()
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
            sizes = np.array([len(x) for x in texts], np.int64)
            starts = np.cumsum(sizes) - sizes
            prefix, suffix = tries(letters, starts, sizes)
            ids = np.repeat(batch.column("id").to_numpy(), sizes + 1)
            base = np.cumsum(sizes + 1) - (sizes + 1)
            at = np.arange(len(prefix)) - np.repeat(base, sizes + 1)
            inner = np.ones(len(prefix), bool)
            inner[base + sizes] = False
            skip = np.flatnonzero(inner)  # one for each letter
            alike = np.concatenate(([False], letters[1:] == letters[:-1])) & (at[skip] > 0)
            columns = [
                np.concatenate((prefix, prefix[skip])).view(np.int64), np.concatenate((suffix, suffix[skip + 1])).view(np.int64), np.concatenate((ids, ids[skip])),
                np.concatenate((at, at[skip])).astype(np.int32), np.concatenate((np.full(len(prefix), PLACE), np.where(alike, SKIPPED, FIRST_SKIPPED))).astype(np.int32),
            ]
            for k in range(0, len(columns[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in columns], ["p", "s", "id", "at", "kind"])

    return words.select("id", "word").mapInArrow(number, "p long, s long, id long, at int, kind int")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, other, n): for each word (id, word, n; written) the words that differ from it by one letter more, less or other, with
    their n. Each such pair is there once from either side."""
    made = cut(nodes(words))
    skipped = made.where(F.col("kind") != PLACE).drop("kind")
    same = ["p", "s", "at"]
    other = skipped.withColumnRenamed("id", "b")
    replaced = skipped.withColumnRenamed("id", "a").join(other, same).where("a < b").select("a", "b", "at", F.lit(1).alias("kept"))
    place = made.where(F.col("kind") == PLACE).select(*same, F.col("id").alias("b"))
    longer = made.where(F.col("kind") == FIRST_SKIPPED).select(*same, F.col("id").alias("a")).join(place, same).select("a", "b", "at", F.lit(0).alias("kept"))
    # kept: whether b has a letter at that place, too.
    found = replaced.union(longer)
    for x in "ab":
        found = found.join(words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n")), x)
    end = F.greatest(F.length("a_word"), F.length("b_word"))
    near = (F.left("a_word", F.col("at")) == F.left("b_word", F.col("at"))) & (F.substring("a_word", F.col("at") + 2, end) == F.substring("b_word", F.col("at") + 1 + F.col("kept"), end))
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), F.col("a_n").alias("n")))
    out = cut(found.where(near).select(F.inline(both)))
    forget(made)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): where forms lead to. A form has RATIO times its variant's n or more, so that there are no
    circles and chains are short: each round doubles the steps taken."""
    step = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = cut(step.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(step)
        step = after
        if step.where("moved").isEmpty():
            return step.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    n_near: near words, by one letter inserted, deleted or replaced; form: the near one of largest n (ties: the smallest
    in the order of code points) if its n is `ratio` times the word's or more, else null; root: where forms lead to from the word,
    itself if it has none. No words give no rows. Words of any length are compared whole.
    """
    words = numbered(words.select("word", "n"))
    near = neighbours(words)
    # A word has a bounded number of near words: the letters there are, for each of its places.
    own = Window.partitionBy("id")
    first = near.withColumns({"n_near": F.count(F.lit(1)).over(own), "nth": F.row_number().over(own.orderBy(F.desc("n"), "other"))}).where("nth = 1")
    own = words.join(first.select("id", "n_near", F.col("n").alias("best_n"), "other"), "id", "left")
    lead = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    table = cut(own.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(lead, F.col("other")).alias("form_id"), F.when(lead, F.col("best_n")).alias("form_n")))
    ends = roots(table.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    forget(near)
    # Names of form and root: two joins of the words that have a form, and of no others.
    led = table.where("form_id is not null").select("id", F.col("form_id")).join(ends, "id")
    for x in ("form", "root"):
        key = "form_id" if x == "form" else "root"
        led = led.join(words.select(F.col("id").alias(key), F.col("word").alias(f"{x}_word")), key)
    named = table.drop("form_id").join(led.select("id", "form_word", "root_word"), "id", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


#: crc32 by the 256 remainders, byte by byte; near words by texts with a hole, or a letter less.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(k))),
o AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h FROM o, t),
c AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, sum(m)::BIGINT AS n FROM h GROUP BY 1 HAVING len(word) >= 5 AND sum(m) >= 3),
e AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM c),
x AS (SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less FROM e),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM x a JOIN x b ON a.hole = b.hole AND a.word <> b.word
UNION SELECT x.word, x.n, c.word, c.n FROM x JOIN c ON x.less = c.word UNION SELECT c.word, c.n, x.word, x.n FROM x JOIN c ON x.less = c.word),
s AS (SELECT word, count(*) AS n_near, max(m) AS best, first(other ORDER BY m DESC, other) AS other FROM p GROUP BY word),
f AS (SELECT c.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * n THEN other END AS form, CASE WHEN best >= 2 * n THEN best END AS form_n FROM c LEFT JOIN s USING (word)),
g AS (SELECT word, word AS root, form FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.form = f.word)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g ON f.word = g.word AND g.form IS NULL
"""
