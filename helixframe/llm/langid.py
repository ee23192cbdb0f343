"""Language ID by prediction by partial matching.

For each language a byte context tree of order 0 to ORDER is counted on a bounded sample of labelled rows and frozen.
The code length of a byte is that of the longest context that has seen it, plus the escapes (method C) from each longer
context that was seen but not with this byte; a context never seen costs nothing. With frozen counts this depends on the
last ORDER + 1 bytes only, so trees are flattened into tables from contexts to escape costs and from byte strings to
costs, one column for each language, and whole pieces of text are looked up at once. The language of the shortest code
wins. Bytes are folded first: A-Z to a-z, other ASCII that isn't a letter to one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import HashIndex, map_batches, pieces, remainder, text_bytes, without

#: Longest context; labelled rows that each language learns from at most, and the longest of them, in characters; characters of
#: all languages' samples together, about, shared evenly (a language has one row at least).
ORDER, SAMPLE_ROWS, SAMPLE_CHARS, ALL_CHARS = 4, 300, 20_000, 24_000_000
#: Languages that share tables, in which a string that one of them has takes room for all; costs that are held at once.
TOGETHER, COSTS = 8, 1 << 22
#: A score weighs a text's mean evidence as that of so many bytes at most, or every long text would score 1.
EVIDENCE_BYTES = 100

FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    languages: list[str]
    #: By order k: keys of strings of k + 1 bytes, their costs in bits; keys of contexts of k bytes, their escape costs.
    strings: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]


def grams(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The last `length` bytes up to each position, as a number; before the start of a row stand spaces."""
    key, n = data.astype(np.uint64), len(data)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at)) if n else np.zeros(0, np.int64)
    for back in range(1, length):
        before = np.full(n, 32, np.uint64)
        before[back:] = data[: n - back] if back < n else 0
        before[place < back] = 32
        key |= before << np.uint64(8 * back)
    return key


def train_all(texts: dict[str, list[str]], order: int = ORDER) -> list[Model]:
    """Models of TOGETHER languages each, in order of their names."""
    names = sorted(texts)
    return [train({x: texts[x] for x in names[k : k + TOGETHER]}, order) for k in range(0, len(names), TOGETHER)]


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    languages = sorted(texts)
    counts = []
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        own = []
        for lang in languages:
            data, at = text_bytes(pa.array(texts[lang], pa.large_string()))
            own.append(np.unique(grams(FOLD[data], at, k + 1) & mask, return_counts=True))
        keys = np.unique(np.concatenate([x for x, _ in own]))
        table = np.zeros((len(keys), len(languages)))
        for j, (x, c) in enumerate(own):
            table[np.searchsorted(keys, x), j] = c
        counts.append((keys, table))
    strings, escapes = [], []
    for k, (keys, table) in enumerate(counts):
        context, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)  # the context is what stands before
        # keys hold the newest byte lowest, so a string's context is its upper bytes.
        total, kinds = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
        np.add.at(total, inverse, table)
        np.add.at(kinds, inverse, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(table / (total + kinds)[inverse])
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        if k == 0:
            below = np.full((len(keys), len(languages)), 8.0)
        else:
            short, costs = strings[k - 1]
            below = costs[np.searchsorted(short, keys & np.uint64((1 << 8 * k) - 1))]
        strings.append((keys, np.where(table > 0, seen, escape[inverse] + below).astype(np.float32)))
        escapes.append((context, escape.astype(np.float32)))
    return Model(languages, strings, escapes)


class Scorer:
    def __init__(self, models: list[Model]):
        self.languages, self.order = [x for m in models for x in m.languages], max((len(m.strings) for m in models), default=1) - 1
        self.models = [(len(m.languages), [(HashIndex(k), c) for k, c in m.strings], [(HashIndex(k), c) for k, c in m.escapes]) for m in models]

    def costs(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each row (rows x languages), by slices of positions."""
        data = FOLD[data]
        out, step = np.zeros((len(at) - 1, len(self.languages))), max(1, COSTS // TOGETHER)
        for a in range(0, len(data), step):
            b = min(len(data), a + step)
            rows = np.arange(np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left"))
            # A position's cost depends on the bytes before it, which may lie before the slice.
            lead = max(a - self.order, int(at[rows[0]]))
            own = np.maximum(at[rows], lead) - lead
            key = grams(data[lead:b], np.append(own, b - lead), self.order + 1)[a - lead :]
            starts = np.maximum(at[rows], a) - a
            some = np.flatnonzero(np.diff(np.append(starts, b - a)))
            done = 0
            for n, strings, escapes in self.models:
                bits = position_costs(key, n, strings, escapes)
                out[rows[some], done : done + n] += np.add.reduceat(bits, starts[some], axis=0, dtype=np.float64)
                done += n
        return out


def position_costs(key: np.ndarray, n: int, strings: list, escapes: list) -> np.ndarray:
    """Bits of each position in each of n languages."""
    bits, left = np.zeros((len(key), n), np.float32), np.arange(len(key))
    for k in range(len(strings) - 1, -1, -1):
        own = key[left] & np.uint64((1 << 8 * (k + 1)) - 1)
        found = strings[k][0].find(own)
        hit = found >= 0
        bits[left[hit]] += strings[k][1][found[hit]]
        left, own = left[~hit], own[~hit]
        if not len(left):
            break
        context = escapes[k][0].find(own >> np.uint64(8))
        known = context >= 0
        bits[left[known]] += escapes[k][1][context[known]]
    bits[left] += 8.0  # below order 0 each byte costs the same
    return bits


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> list[Model] | None:
    """Models of every language, of up to `rows` rows of each, of at most `chars` characters, first by a hash of the text. A language
    all of whose texts are longer learns from its shortest ones. Where languages are so many that these may be more than all_chars
    characters together, each learns from its share of those, rows first by the hash until it is reached.

    Only text and lang are read; a text that repeats counts once. None if no row has both. Hashes below a limit are
    taken, which the languages' numbers of different texts give, so that only the sample is shuffled, copies put together
    first; what reaches the driver is bounded by all_chars and a row of each language, about, however many copies a text has.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    size, seen = F.length("text"), F.xxhash64("text")
    short = F.when(size <= chars, seen)
    n = usable.groupBy("lang").agg(F.approx_count_distinct(short).alias("n"), F.min(size).alias("least"), F.avg(F.when(size <= chars, size)).alias("mean"))
    found = n.collect()  # a row for each language
    if not found:
        return None
    share = all_chars / len(found)
    wanted = {r["lang"]: max(1, min(rows, int(share / max(1.0, r["mean"] or 1.0)))) for r in found}
    spare = lambda k: 30 if k == rows else 10
    part = lambda k, n: int(min(1.0, 1.3 * k / n + spare(k) / n) * (1 << 30)) if n else 1 << 30
    limits = labelled.sparkSession.createDataFrame([(r["lang"], part(wanted[r["lang"]], r["n"]), max(chars, r["least"])) for r in found], "lang string, share long, longest int")
    draw = F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 30)).alias("draw")
    texts: dict[str, list] = {r["lang"]: [] for r in found}
    sample = usable.join(F.broadcast(limits), "lang").where(size <= F.col("longest")).select("lang", "text", "share", draw).where("draw < share")  # a row for each language
    for r in sample.drop("share").distinct().toLocalIterator():
        texts[r["lang"]].append((r["draw"], r["text"]))
    return train_all({lang: within([t for _, t in sorted(x)[: wanted[lang]]], share) for lang, x in texts.items() if x})


def within(texts: list[str], chars: float) -> list[str]:
    """The first texts of `chars` characters together, one at least."""
    ends = np.cumsum([len(x) for x in texts])
    return texts[: max(1, int(np.searchsorted(ends, chars, "right")))]


def predict(docs: DataFrame, model: list[Model] | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score: the likeliest learned language and its probability.

    Null texts and those without a letter are `und` with score 0, as is everything if nothing was learned. Long texts
    are read whole; evidence is weighed by the byte, so that a score isn't 1 for length alone. Ties go to the language
    first by name. Other columns pass through, but for those that have one of `names`, the two new ones,
    which are replaced. No documents give no rows.
    """
    docs = without(docs, *names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = "_helix_letter"

    def scan(batches):
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for part, data, at in pieces(batch):
                has = np.asarray(part.column(letter).fill_null(False))
                if scorer is None:
                    found, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    bits = scorer.costs(data, at)
                    best = bits.argmin(1)
                    size = np.maximum(1, np.diff(at))
                    gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1, EVIDENCE_BYTES / size)[:, None]
                    score = np.where(has, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
                    found = [scorer.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                own = [c for c in part.schema.names if c != letter]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array(found, pa.string()), pa.array(score)], [*own, *names])

    return map_batches(docs.withColumn(letter, F.col("text").rlike(r"\p{L}")), scan, schema)


def keep_known(docs: DataFrame, languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """Documents in a learned language (one of `languages`, if given) with a score of at least `least`; others go.
    Learns from the rows of docs that have a lang, as op6 does."""
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    found = predict(docs, model, ("_helix_lang", "_helix_score")).where((F.col("_helix_lang") != "und") & (F.col("_helix_score") >= least))
    return (found if languages is None else found.where(F.col("_helix_lang").isin(languages))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    found = predict(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
