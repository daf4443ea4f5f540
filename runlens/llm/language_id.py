"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of
  * the likelihood of the text under character trigrams, tempered because neighbouring trigrams are not independent,
  * the likelihood of the declared language (a markup attribute or a column), from how often texts that read as a
    language carry each declaration,
  * the likelihood of the address suffix, counted likewise,
  * the prior of the host, smoothed towards the prior of its domain and that towards the prior of the whole corpus.
All counts are grouped aggregations over the whole corpus; the document's own share is taken out of its priors.

Characters fall into classes by code point: ASCII letters by themselves, other Latin, Greek and Cyrillic letters into
a few classes a script, and further scripts into one or a few each, so that no two of these scripts meet in a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, drop_rows, free_large_caches, sign_of, small_batches, worker_cache

#: The classifier is fitted on about so many labelled rows, chosen by a hash of the identifier, whose texts have at
#: most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Share of a trigram's log likelihood that counts, added counts of trigrams, and strength of the two smoothings.
TEMPER, ALPHA, DOMAIN_STRENGTH, HOST_STRENGTH = 0.3, 0.5, 20.0, 10.0
#: A text with fewer letter trigrams than this, or with a lower posterior than this, has no sure language.
MIN_TRIGRAMS, MIN_POSTERIOR = 3, 0.5
#: Hosts up to which their priors are broadcast; more are joined by a shuffle.
MAX_BROADCAST_HOSTS = 200_000
#: The name of the background language, whose trigrams are all alike, and of no language.
BACKGROUND, UNKNOWN = "other", "und"

#: Ranges of code points, the first of their classes, and the number of these.
CLASSES = 96
SCRIPTS = [
    (0x00C0, 0x0250, 27, 16),  # Latin with marks
    (0x1E00, 0x1F00, 27, 16),
    (0x0370, 0x0400, 43, 6),  # Greek
    (0x1F00, 0x2000, 43, 6),
    (0x0400, 0x0530, 49, 16),  # Cyrillic
    (0x0530, 0x0590, 65, 2),  # Armenian
    (0x0590, 0x0600, 67, 3),  # Hebrew
    (0x0600, 0x0780, 70, 5),  # Arabic
    (0x0900, 0x0980, 75, 2),  # Devanagari
    (0x0980, 0x0E00, 77, 4),  # other scripts of India
    (0x0E00, 0x0F00, 81, 2),  # Thai, Lao
    (0x0F00, 0x10A0, 83, 2),  # Tibetan, Myanmar
    (0x10A0, 0x1100, 85, 2),  # Georgian
    (0x3040, 0x3100, 87, 2),  # Kana
    (0x3400, 0xA000, 89, 2),  # Han
    (0xAC00, 0xD7B0, 91, 2),  # Hangul
    (0x20000, 0x32000, 89, 2),  # Han
]


def class_table() -> Any:
    """Code points to classes: a-z 1 to 26 whatever their case, letters of SCRIPTS theirs, all else 0."""
    import numpy as np

    table = np.zeros(0x32000, dtype=np.uint8)
    for c in range(26):
        table[[65 + c, 97 + c]] = c + 1
    for start, end, first, n in SCRIPTS:
        table[start:end] = first + np.arange(start, end) % n
    table[[0xD7, 0xF7]] = 0
    return table


def trigrams(text: str, table: Any) -> Any:
    """Codes of the class trigrams that have a letter in their middle."""
    import numpy as np

    padded = f" {text} "
    points = np.frombuffer(padded.encode(), dtype=np.uint8) if padded.isascii() else np.minimum(np.frombuffer(padded.encode("utf-32-le"), dtype="<u4"), len(table) - 1)
    c = table[points].astype(np.int32)
    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    return code[c[1:-1] > 0]


class TrigramModel:
    """Log likelihoods of each trigram's last class after the first two, per language and for the background."""

    def __init__(self, labelled: list[tuple[str, str]], alpha: float = ALPHA):
        import numpy as np

        self.languages = sorted({lang for lang, _ in labelled})
        table = class_table()
        counts = np.zeros((len(self.languages), CLASSES**2, CLASSES))
        for lang, text in labelled:
            code, n = np.unique(trigrams(text, table), return_counts=True)
            counts[self.languages.index(lang)].reshape(-1)[code] += n
        own = (counts + alpha) / (counts.sum(axis=2, keepdims=True) + alpha * CLASSES)
        flat = np.full((1, CLASSES**2, CLASSES), 1 / 30)  # about as many classes as letters in use
        self.table = np.log(np.concatenate([own, flat])).reshape(len(self.languages) + 1, -1).T.astype(np.float32).copy()
        self.names = [*self.languages, BACKGROUND]


def score(likely: Any, text: str, classes: Any) -> tuple[Any, int]:
    """(the sums of a model's log likelihoods over a text's trigrams, the number of these)."""
    import numpy as np

    codes = trigrams(text, classes)
    total = np.zeros(likely.shape[1])
    for at in range(0, len(codes), 100_000):
        total += likely[codes[at : at + 100_000]].sum(axis=0, dtype=np.float64)
    return total, len(codes)


def _likelihoods(model: Any, names: list[str], temper: float) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        free_large_caches()
        likely, classes = model.value, worker_cache("language-classes", class_table)
        for batch in source:
            if not batch.num_rows:
                continue
            found = [score(likely, text, classes) for text in batch.column(1).to_pylist()]
            values = np.stack([v for v, _ in found]) * temper
            sizes = [n for _, n in found]
            best = [names[i] if n else None for i, n in zip(values.argmax(axis=1).tolist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sizes, type=pa.int64()), pa.array(best, type=pa.string()), pa.array(values.tolist(), type=pa.list_(pa.float64()))], names=["doc_id", "sign", "declared", "host", "suffix", "trigrams", "reads_as", "ll"])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> TrigramModel:
    """Fit on a bounded sample of labelled rows; rows with a null label or text do not count."""
    usable = labelled.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l")).where(F.col("l").isNotNull() & F.length("t").between(1, sample_chars))
    n = usable.count()
    share = min(1.0, 1.3 * sample_rows / max(1, n))
    picked = usable.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(2 * sample_rows)
    return TrigramModel([(r.l, r.t) for r in picked.collect()])


def identify(df: DataFrame, model: TrigramModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, temper: float = TEMPER, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """One row per input row: doc_id, sign (the text's hash), language, posterior, text_language, declared, trigrams,
    accepted.

    `declared` and `host` are optional columns of df; the suffix is the last label of a host with a dot and the
    domain its last two labels. A declaration counts by its first subtag in lower case. language is the one of the
    largest posterior, "und" where the text has fewer than MIN_TRIGRAMS letter trigrams, the background wins or
    the posterior is below min_posterior; only those rows are not accepted. Of languages with the same posterior the
    first in alphabetical order counts, and a language before the background.

    Null and empty texts have no trigrams and are not accepted. A null declaration, host or suffix is no evidence.
    Null ids and repeated rows are scored row by row. An empty table gives an empty result. A model without
    languages accepts nothing.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "language")
    small_batches(spark)
    names, n_lang = model.names, len(model.languages)
    none = F.lit(None).cast("string")
    tag = F.nullif(F.substring_index(F.substring_index(F.lower(F.trim(declared if declared is not None else none)), "-", 1), "_", 1), F.lit(""))
    name = F.nullif(F.lower(F.trim(host if host is not None else none)), F.lit(""))
    inputs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), sign_of(F.col(text_col)).alias("sign"), tag.alias("declared"), name.alias("host"), F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).alias("suffix"))
    sent = spark.sparkContext.broadcast(model.table)  # plain numbers, which need none of our classes
    seen = scratch.write(inputs.mapInArrow(_likelihoods(sent, names, temper), "doc_id long, sign long, declared string, host string, suffix string, trigrams long, reads_as string, ll array<double>"), "seen")
    if not n_lang:
        return seen.select("doc_id", "sign", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), "declared", "trigrams", F.lit(False).alias("accepted"))

    sure = seen.where(F.col("reads_as").isNotNull())
    counts = lambda c: [F.count_if(F.col("reads_as") == F.lit(x)).cast("double").alias(f"{c}_{i}") for i, x in enumerate(names)]
    whole = sure.agg(*counts("n")).first()
    base = [(x + 1.0) for x in whole]
    base = [x / sum(base) for x in base]
    array = lambda items: F.array(*items)

    def evidence(column: str) -> DataFrame:
        """log P(value | language) for each value, with one added count for every value and one for unseen ones."""
        table = sure.where(F.col(column).isNotNull()).groupBy(column).agg(*counts("n"))
        stats = table.agg(F.count(F.lit(1)), *[F.sum(f"n_{i}") for i in range(len(names))]).first()
        values = [F.log((F.col(f"n_{i}") + 1.0) / F.lit((stats[i + 1] or 0.0) + stats[0] + 1.0)) for i in range(len(names))]
        return table.select(F.col(column).alias(f"{column}_key"), array(values).alias(f"{column}_ev"))

    domain = F.substring_index("host", ".", -2)
    hosts = scratch.write(sure.where("host IS NOT NULL").groupBy("host").agg(*counts("h")), "hosts")
    domains = hosts.groupBy(domain.alias("domain")).agg(*[F.sum(f"h_{i}").alias(f"d_{i}") for i in range(len(names))])
    priors = hosts.withColumn("domain", domain).join(domains, "domain").select(F.col("host").alias("host_key"), array([F.col(f"h_{i}") for i in range(len(names))]).alias("h"), array([F.col(f"d_{i}") for i in range(len(names))]).alias("d"))
    priors = scratch.write(priors, "priors")

    joined = seen.join(bounded_broadcast(priors, MAX_BROADCAST_HOSTS), F.col("host") == F.col("host_key"), "left")
    for column in ("declared", "suffix"):
        table = scratch.write(evidence(column), column)
        joined = joined.join(bounded_broadcast(table, MAX_BROADCAST_HOSTS), F.col(column) == F.col(f"{column}_key"), "left")
    own = [F.when(F.col("reads_as") == F.lit(x), 1.0).otherwise(0.0) for x in names]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    d_total, h_total = F.greatest(total(F.col("d")) - 1.0, F.lit(0.0)), F.greatest(total(F.col("h")) - 1.0, F.lit(0.0))
    logs = []
    for i in range(len(names)):
        d = (F.col("d")[i] - own[i] + DOMAIN_STRENGTH * base[i]) / (d_total + DOMAIN_STRENGTH)
        h = (F.col("h")[i] - own[i] + HOST_STRENGTH * d) / (h_total + HOST_STRENGTH)
        prior = F.log(F.coalesce(h, F.lit(base[i])))
        logs.append(prior + F.coalesce(F.col("declared_ev")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_ev")[i], F.lit(0.0)) + F.col("ll")[i])
    scored = joined.withColumn("log", array(logs))
    top = F.array_max("log")
    scored = scored.withColumns({"top": top, "norm": F.aggregate(F.transform("log", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)})
    best = F.element_at(array([F.lit(x) for x in names]), F.array_position("log", F.col("top")).cast("int"))
    posterior = 1.0 / F.col("norm")
    accepted = (F.col("trigrams") >= MIN_TRIGRAMS) & (best != BACKGROUND) & (posterior >= min_posterior)
    return scored.select("doc_id", "sign", F.when(accepted, best).otherwise(UNKNOWN).alias("language"), F.when(F.col("trigrams") > 0, posterior).otherwise(0.0).alias("posterior"), F.col("reads_as").alias("text_language"), "declared", "trigrams", accepted.alias("accepted"))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """doc_id, text, declared and host of web pages: the text without markup, the lang attribute, the URL's host."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z_-]*)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract(F.col(url_col).cast("string"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(body, r"<[^>]*>|&[#\w]+;", " ").alias("text"), declared.alias("declared"), host.alias("host"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of docs with a sure language, with the columns of docs.

    The labels fit the model and are no evidence; text and host are. Rows that repeat an id are judged by their own
    text each, also those with a null id. Null and empty texts go. Without any label, or from an empty table, no row
    stays.
    """
    found = identify(docs, fit(docs, id_col, text_col, label_col), id_col, text_col, host=F.col(host_col).cast("string"))
    gone = Scratch(docs.sparkSession, "language-gone").write(found.where("NOT accepted").select("doc_id", "sign"), "removed")
    return drop_rows(docs, id_col, text_col, gone)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents and pages: origin, doc_id and what identify tells.

    The model is fitted on labelled documents. Documents have their text and their source as host; their label is no
    evidence. Pages have the declared markup language, the address's suffix, and host and domain priors as well. A
    page's doc_id is -1 - page_id, so that no two rows share one.
    """
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    none = F.lit(None).cast("string")
    own = docs.select("doc_id", "text", none.alias("declared"), F.col("source").cast("string").alias("host"))
    web = page_evidence(pages).withColumn("doc_id", -1 - F.col("doc_id"))
    found = identify(own.unionByName(web), fit(docs), declared=F.col("declared"), host=F.col("host"))
    return found.drop("sign").withColumn("origin", F.when(F.col("doc_id") < 0, "page").otherwise("document"))
