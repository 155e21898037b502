"""Language identification by Bayesian fusion of what the text, its markup, its address and its host say.

Text: likelihoods of byte trigrams, from a bounded sample of declared texts; a class ``und`` gives all trigrams the same
likelihood and wins where no language fits. Markup and address: likelihoods of the declared language and the address
suffix given the language. Host: a prior smoothed toward its suffix's, and that toward the corpus's. All but the
trigrams come from counts over all rows by grouped aggregation, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_tools, local_rows, sliced, trimmed, written
from .common import utf8 as bytes_of

#: Declared texts that the trigrams are learned on, about, chosen by a hash; of each language so many at least, if there are.
SAMPLE, EACH = 4000, 50
#: Declared texts that a language needs, of all rows.
LEAST = 3
#: Trigrams overlap and depend on each other: the share of their evidence that counts.
TEMPER = 0.125
#: Rows' worth of belief that a host takes from its suffix, and a suffix from the corpus; pseudo-counts of an evidence.
HOST_WEIGHT, PSEUDO = 20.0, 1.0
#: Rows of a table of priors, each an array of a double a language, that are broadcast at most.
BROADCAST_ROWS = 50_000
UND, UND_PRIOR = "und", 0.01
SLICE = 1 << 20


def _symbols() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for i in range(26):
        out[97 + i] = out[65 + i] = i + 1
    out[128:] = 27 + np.arange(128) % 37
    return out


SYMBOLS = _symbols()


def trigrams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The trigram that begins at each byte, as 18 bits; 0 for those without letters and those that leave their text."""
    s = np.concatenate([SYMBOLS[data], np.zeros(2, np.int32)])
    code = s[:-2] | (s[1:-1] << 6) | (s[2:] << 12)
    for back in (1, 2):
        ends = at[1:] - back
        code[ends[ends >= at[:-1]]] = 0
    return code


def learn(rows: list[tuple[str | None, str]]) -> tuple[list[str], np.ndarray]:
    """Languages, ``und`` last, and the log likelihood of each trigram in each (2^18 x languages)."""
    texts: dict[str, list[bytes]] = {}
    for text, lang in rows:
        if text:
            texts.setdefault(lang, []).append(text.encode("utf-8", "replace"))
    langs = sorted(k for k, v in texts.items() if len(v) >= LEAST and k != UND)
    table = np.full((1 << 18, len(langs) + 1), -np.log(1 << 15), np.float32)
    for i, lang in enumerate(langs):
        joined = texts[lang]
        at = np.cumsum([0, *map(len, joined)])
        counts = np.bincount(trigrams(np.frombuffer(b"".join(joined), np.uint8), at), minlength=1 << 18).astype(float)
        counts[0] = 0
        table[:, i] = np.log((counts + 0.05) / (counts.sum() + 0.05 * (1 << 18)))
    table[0] = 0
    return [*langs, UND], table


def declared_sample(rows: DataFrame) -> list[tuple[str, str]]:
    """(text, declared) to learn on: about ``SAMPLE`` of all in proportion, and ``EACH`` of a language or all that it has.

    How many texts declare a language is counted over all rows; those below ``LEAST`` are no languages.
    """
    rows = rows.where((F.col("declared") != "") & (F.col("declared") != UND) & (F.col("text") != ""))
    counts = {r["declared"]: r["n"] for r in rows.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).collect()}
    if not counts:
        return []
    whole = sum(counts.values())
    shares = [(lang, int(min(1.0, max(SAMPLE / whole, EACH / n)) * (1 << 31))) for lang, n in counts.items()]
    shares = F.broadcast(local_rows(rows.sparkSession, shares, "declared string, below long"))  # a row a language
    chosen = rows.join(shares, "declared").where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33) < F.col("below"))
    return [(r["text"], r["declared"]) for r in chosen.select("text", "declared").limit(2 * (SAMPLE + EACH * len(counts))).toArrow().to_pylist()]


def _evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Per row: its tempered log likelihoods, the language its text alone suggests, and what else is known of it."""
    sent = rows.sparkSession.sparkContext.broadcast(table)  # 1 MB a language
    said = [f for f in rows.schema if f.name != "text"]
    own = [T.StructField("letters", T.LongType()), T.StructField("guess", T.IntegerType()), *(T.StructField(f"l{i}", T.DoubleType()) for i in range(len(langs)))]
    names = [f.name for f in [*said, *own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tools()
        columns = [np.ascontiguousarray(c) for c in sent.value.T]
        for batch in batches:
            for part in sliced(batch, batch.schema.get_field_index("text"), SLICE):
                data, at = bytes_of(part.column("text"))
                sums = np.zeros((part.num_rows, len(columns)))
                letters = np.zeros(part.num_rows, np.int64)
                held = np.flatnonzero(at[1:] > at[:-1])
                size = SLICE if part.num_rows == 1 else len(data)  # a long text is a slice of its own, read in windows
                for a in range(0, len(data), max(size, 1)):
                    own = data[a : a + size + 2]
                    begins, offsets = (at[held], at) if part.num_rows > 1 else (np.zeros(1, np.int64), np.array([0, len(own)]))
                    code = trigrams(own, offsets)[:size]
                    for n, c in enumerate(columns):
                        sums[held, n] += np.add.reduceat(c[code], begins, dtype=np.float64)
                    letters[held] += np.add.reduceat((SYMBOLS[own[:size]] > 0).astype(np.int64), begins)
                sums *= TEMPER
                guess = np.where(letters > 0, sums.argmax(1), -1).astype(np.int32)
                passed = [part.column(f.name) for f in said]
                yield pa.RecordBatch.from_arrays([*passed, pa.array(letters), pa.array(guess), *map(pa.array, sums.T.copy())], names)

    return rows.mapInArrow(trimmed(run), T.StructType([*said, *own]))


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", suffix_col: str | None = None, host_col: str | None = "source", least: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, language, confidence, accepted), one row a row of ``df``; with ``keep`` those columns of it as well, in a struct ``kept``.

    ``declared``, ``suffix`` and ``host`` may be missing or null: then they say nothing. A text without letters (null
    and empty ones too) is ``und``. ``accepted``: the language isn't ``und`` and its posterior is at least ``least``.
    Ties go to the language that is first by name. Null ids and repeated rows are rows like others.
    """
    bounded_batches(df.sparkSession)
    column = lambda c: (F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.lower(F.substring_index(column(declared_col), "-", 1)).alias("declared"), F.lower(column(suffix_col)).alias("suffix"), F.lower(column(host_col)).alias("host"), F.coalesce(column(text_col), F.lit("")).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []))
    langs, table = learn(declared_sample(rows))
    known, k = written(_evidence(rows, langs, table), "evidence"), len(langs)

    # counts over all rows of the language that the text suggests: of the corpus, and by each evidence
    seen = known.where("guess >= 0")
    ones = [F.sum(F.when(F.col("guess") == i, 1).otherwise(0)).cast("double") for i in range(k)]
    total = np.array([x or 0.0 for x in seen.agg(*ones).first()]) + 1.0
    prior = total / total.sum()
    prior[-1] = UND_PRIOR
    prior /= prior.sum()

    def priors(by: str) -> DataFrame:
        return seen.where(F.col(by).isNotNull()).groupBy(by, *(["suffix"] if by == "host" else [])).agg(F.array(*ones).alias("c"))

    def smoothed(counts: Column, base: Column) -> Column:
        whole = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.transform(F.arrays_zip(counts.alias("c"), base.alias("b")), lambda p: (p["c"] + HOST_WEIGHT * p["b"]) / (whole + HOST_WEIGHT))

    def small(table: DataFrame, name: str) -> DataFrame:
        """Written and counted; few rows are broadcast, so that the texts' rows stay where they are."""
        table = written(table, name)
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    corpus = F.array(*map(F.lit, map(float, prior)))
    suffixes = small(priors("suffix").select(F.col("suffix").alias("suffix_"), smoothed(F.col("c"), corpus).alias("suffix_prior")), "suffixes")
    hosts = priors("host").join(suffixes, F.col("suffix") == F.col("suffix_"), "left")
    hosts = small(hosts.select(F.col("host").alias("host_"), F.col("suffix").alias("host_suffix"), smoothed(F.col("c"), F.coalesce("suffix_prior", corpus)).alias("host_prior")), "hosts")
    declared = small(priors("declared").select(F.col("declared").alias("declared_"), F.transform("c", lambda c: F.log(c + PSEUDO)).alias("declared_like")), "declared")

    joined = (
        known.join(declared, known["declared"] == declared["declared_"], "left")
        .join(suffixes, known["suffix"] == suffixes["suffix_"], "left")
        .join(hosts, (known["host"] == hosts["host_"]) & known["suffix"].eqNullSafe(hosts["host_suffix"]), "left")
    )
    base = F.coalesce("host_prior", "suffix_prior", corpus)
    logs = [float(np.log(x)) for x in total + PSEUDO * max(k, 1)]
    nothing = F.array(*[F.lit(0.0)] * k)
    like = lambda c: F.coalesce(F.transform(c, lambda x, i: x - F.element_at(F.array(*map(F.lit, logs)), i + 1)), nothing)
    # the suffix speaks through the prior of its hosts, or its own where no host is known
    parts = F.arrays_zip(F.array(*[F.col(f"l{i}") for i in range(k)]).alias("t"), F.transform(base, lambda p: F.log(p)).alias("h"), like("declared_like").alias("d"))
    scores = F.transform(parts, lambda p: p["t"] + p["h"] + p["d"])
    best = joined.withColumn("scores", scores).withColumn("top", F.array_max("scores"))
    best = best.withColumn("at", F.array_position("scores", F.col("top"))).withColumn("confidence", 1 / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))))
    language = F.when(F.col("letters") > 0, F.element_at(F.array(*map(F.lit, langs)), F.col("at").cast("int"))).otherwise(UND)
    return best.select("doc_id", language.alias("language"), F.when(F.col("letters") > 0, F.col("confidence")).otherwise(F.lit(1.0)).alias("confidence"), *(["kept"] if keep else [])).withColumn("accepted", (F.col("language") != UND) & (F.col("confidence") >= least))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as rows for ``identify``: doc_id, text, lang, suffix, host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    lang = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1)
    none = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("doc_id"), text.alias("text"), none(lang).alias("lang"), none(F.regexp_extract(host, r"\.([a-zA-Z]+)$", 1)).alias("suffix"), none(host).alias("host"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_page_language_id(spark, sf_dir: str) -> DataFrame:
    """The whole of ``pages`` with all evidence: text, declared markup language, host and address suffix; doc_id is page_id."""
    return identify(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), suffix_col="suffix", host_col="host")
