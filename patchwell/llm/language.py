"""Language by Bayesian evidence: text, declared language, address suffix and host.

Byte n-grams give each language's likelihood of the text. Declared languages and address
suffixes are evidence with likelihoods of their own, and a host's mix of languages is the prior;
all three are counted over every row, with the texts' own verdicts as soft counts, and a host
with few rows leans on its domain, a domain on the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.llm.common import free_name, given_columns, make_room, row_key, utf8, written

GRAM = 4
BUCKET_BITS = 15
#: Labelled rows of each language that the text model is fitted on, on average at most.
SAMPLE_ROWS = 2_000
#: Overlapping grams repeat each other's evidence, so each counts for a part.
GRAM_WEIGHT = 1 / GRAM
#: Rows that the next wider level counts for.
PRIOR_ROWS = 20.0
#: Grams that a text counts for at most when the model is fitted: one long text is no language.
TEXT_GRAMS = 1_000.0
#: Log probability of a gram in a text of no language: all buckets alike.
BACKGROUND = -BUCKET_BITS * float(np.log(2))
_SCAN_BYTES = 1 << 20
#: Log probabilities that are added up at once.
_SCAN_LOGS = 1 << 23


@dataclass
class TextModel:
    """``log[b, l]``: log probability of gram bucket b in language l."""

    languages: list[str]
    log: np.ndarray


def _buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the gram at each place, and whether it has a letter; A-Z count as a-z, digits and
    signs as one."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[:65] = 32
    fold[91:97] = fold[123:128] = 32
    data = fold[data]
    code = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        code = code * np.uint32(257) + data[k : k + len(code)]
    letters = np.concatenate([[0], np.cumsum(data != 32)])
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), letters[GRAM:] > letters[:-GRAM]


def _portions(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of several texts' grams with letters, and the number of the text each belongs to."""
    first = size = 0
    for k in range(len(texts) + 1):
        if k == len(texts) or k > first and size + len(texts[k]) > _SCAN_BYTES:
            some = [b" " + x + b" " for x in texts[first:k]]
            data = np.frombuffer(b"".join(some), np.uint8)
            owner = np.repeat(np.arange(first, k), [len(x) for x in some])
            inside = owner[: len(data) - GRAM + 1] == owner[GRAM - 1 :] if len(data) >= GRAM else np.zeros(0, bool)
            if len(inside):
                found, letters = _buckets(data)
                inside &= letters
                yield found[inside], owner[: len(inside)][inside]
            first, size = k, 0
        if k < len(texts):
            size += len(texts[k])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fits on about ``sample_rows`` rows ``key, text, language`` of each language, chosen by a hash of
    the key: each row by itself, so nothing is sorted or moved. Every language with labelled rows is
    fitted; the driver gets 4 bytes for each language and bucket."""
    rows = labelled.select("key", utf8("text").alias("text"), "language").where("language is not null")
    common = labelled.where("language is not null").groupBy("language").count()
    common = {x[0]: x[1] for x in common.collect()}
    if not common:
        return TextModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    languages = sorted(common)
    rates = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / common[k]))))
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(share < F.coalesce(F.try_element_at(rates, F.col("language")), F.lit(0.0)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column("language").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for language in set(languages):
                own = [texts[i] for i in np.flatnonzero(languages == language)]
                sums = np.zeros(1 << BUCKET_BITS)
                for buckets, owner in _portions(own):
                    weights = np.minimum(1.0, TEXT_GRAMS / np.maximum(1, np.bincount(owner)))
                    sums += np.bincount(buckets, weights[owner], minlength=len(sums))
                used = np.flatnonzero(sums)
                n = len(used)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * n, pa.string()), pa.array(used), pa.array(sums[used])], names=["language", "bucket", "n"]
                )

    grams = sample.select("text", "language").mapInArrow(count, "language string, bucket long, n double")

    def packed(part: pa.Table) -> pa.Table:
        sums = np.zeros(1 << BUCKET_BITS)
        np.add.at(sums, part.column("bucket").to_numpy(), part.column("n").to_numpy())
        return pa.table({"language": part.column("language")[:1], "n": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})

    grams = grams.groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((1 << BUCKET_BITS, len(languages)), np.float32)
    for language, n in grams.groupBy("language").applyInArrow(packed, "language string, n binary").collect():
        counts[:, place[language]] = np.frombuffer(n, np.float32)
    smooth = counts + 0.5
    return TextModel(languages, np.log(smooth / smooth.sum(axis=0, dtype=np.float64)).astype(np.float32))


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` with ``grams`` (how many with letters the text has) and ``likelihood`` (a log for each language)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by languages and buckets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        log = shared.value.log
        for batch in batches:
            n = batch.num_rows
            grams, sums = np.zeros(n, np.int64), np.zeros((n, log.shape[1]))
            for buckets, owner in _portions(batch.column("_utf8").to_pylist()):
                step = max(1, _SCAN_LOGS // max(1, log.shape[1]))
                for at in range(0, len(owner), step):
                    own = owner[at : at + step]
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    sums[own[starts]] += np.add.reduceat(log[buckets[at : at + step]], starts, axis=0, dtype=np.float64)
                    grams[own[starts]] += np.diff(np.append(starts, len(own)))
            kept = batch.drop_columns(["_utf8"])
            columns = [pa.array(grams), pa.array(list(sums * GRAM_WEIGHT), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "grams", "likelihood"])

    given = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.drop("_utf8").schema)
    return rows.mapInArrow(run, f"{given}, grams long, likelihood array<double>")


def _shares(log: Column) -> Column:
    """Probabilities from logs."""
    top = F.array_max(log)
    odds = F.transform(log, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


def _soft_counts(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """Sums of the texts' own verdicts by key; aggregated in parts before any shuffle."""
    return rows.groupBy(*key).agg(F.array(*(F.sum(F.col("share")[i]) for i in range(n))).alias("sums"))


def _numbers(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _smoothed(sums: Column, wider: Column) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, wider, lambda s, w: (s + PRIOR_ROWS * w) / (total + PRIOR_ROWS))


def evidence_tables(rows: DataFrame, n: int) -> dict[str, DataFrame]:
    """Log likelihoods of declared values and suffixes, and log priors of hosts, each one row for a
    key. ``rows``: ``host, suffix, declared, share``; nulls are a value like any other for hosts,
    and no evidence for the two others."""
    sums = np.array(_soft_counts(rows, [], n).first()[0], float)  # a number for each language
    sums = np.nan_to_num(sums)
    whole = _numbers((sums + PRIOR_ROWS / n) / (sums.sum() + PRIOR_ROWS))
    by_host = written(_soft_counts(rows, ["host"], n).withColumn("domain", domain_of("host")), "hosts")
    domains = by_host.groupBy("domain").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(n))).alias("sums"))
    domains = domains.select("domain", _smoothed(F.col("sums"), whole).alias("wider"))
    hosts = by_host.alias("h").join(domains.alias("d"), F.expr("h.domain <=> d.domain"))
    hosts = hosts.select("h.host", _smoothed(F.col("h.sums"), F.col("d.wider")).alias("prior"))
    out = {"host": hosts.select("host", F.transform("prior", lambda x: F.log(x)).alias("host_log"))}
    for key in ("declared", "suffix"):
        some = rows.where(F.col(key).isNotNull())
        table = written(_soft_counts(some, [key], n), key)
        values = table.count() + 1
        totals = np.nan_to_num(np.array(_soft_counts(some, [], n).first()[0], float))
        log = F.zip_with("sums", _numbers(totals), lambda s, t: F.log((s + 1) / (t + values)))
        out[key] = table.select(key, log.alias(f"{key}_log"))
    return out


def fuse(rows: DataFrame, model: TextModel) -> DataFrame:
    """Adds ``language``, ``probability``, ``text_language`` and ``recognised`` to rows of ``host, suffix,
    declared, grams, likelihood``.

    A text without grams says nothing and the rest decides. ``recognised``: the text has grams, its
    best language explains them better than the background of equal grams does, and one language
    is more likely than all others together. Texts of the background count for no prior. The text's share of the verdict that
    counted for its own host's prior is small beside the host's rows and the prior's weight."""
    n = len(model.languages)
    if not n:
        empty = {"language": "string", "text_language": "string"}
        rows = rows.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()})
        return rows.withColumns({"probability": F.lit(0.0), "recognised": F.lit(False)}).drop("likelihood")
    shares = rows.withColumn("share", _shares(F.col("likelihood")))
    known = (F.col("grams") > 0) & (F.array_max("likelihood") > F.col("grams") * F.lit(BACKGROUND * GRAM_WEIGHT))
    tables = {k: written(v, k) for k, v in evidence_tables(shares.where(known), n).items()}
    none = F.array(*[F.lit(0.0)] * n)
    joined = rows.alias("r").join(
        tables["host"].withColumnRenamed("host", "_host"), F.expr("r.host <=> _host"), "left"
    )
    joined = joined.drop("_host").join(tables["declared"], "declared", "left")
    joined = joined.join(tables["suffix"], "suffix", "left")
    log = F.col("likelihood")
    for part in ("host_log", "declared_log", "suffix_log"):
        log = F.zip_with(log, F.coalesce(part, none), lambda a, b: a + b)
    names = F.array(*map(F.lit, model.languages))
    verdict = joined.withColumn("_shares", _shares(log))
    best = F.array_max("_shares")
    verdict = verdict.withColumns(
        {
            "language": names[F.array_position("_shares", best).cast("int") - 1],
            "probability": best,
            "text_language": F.when(F.col("grams") > 0, names[F.array_position("likelihood", F.array_max("likelihood")).cast("int") - 1]),
            "recognised": known & (best > 0.5),
        }
    )
    return verdict.drop("_shares", "likelihood", "host_log", "declared_log", "suffix_log")


def markup_language(html: str) -> Column:
    """The language that a page's root element declares, without region; null if none."""
    bare = F.regexp_replace(F.col(html), r"(?s)<!--.*?(?:-->|\z)", "")
    root = F.regexp_extract(bare, r"(?i)<html\b[^>]*>?", 0)
    found = F.regexp_extract(root, r"(?i)\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.lower(F.nullif(found, F.lit("")))


def host_of(url: str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def domain_of(host: str) -> Column:
    """The last two labels of a host; all of it if it has fewer."""
    labels = F.regexp_extract(F.col(host), r"([^.]+\.[^.]+)$", 1)
    return F.coalesce(F.nullif(labels, F.lit("")), F.col(host))


def suffix_of(url: str) -> Column:
    return F.nullif(F.regexp_extract(host_of(url), r"\.([a-z0-9-]+)$", 1), F.lit(""))


def identify(rows: DataFrame, key: str, labelled: DataFrame | None = None) -> DataFrame:
    """``key, language, probability, text_language, declared, grams, recognised`` for rows of
    ``key, text, declared, host, suffix``. ``labelled`` (``key, text, language``) trains the text model; by
    default the rows themselves do, with the declared values as labels.

    Null and empty texts have no grams and are not recognised; null hosts share one prior; null
    declared values and suffixes are no evidence; repeated rows each get theirs; an empty table
    gives no rows."""
    if labelled is None:
        labelled = rows.select(F.col(key).alias("key"), "text", F.col("declared").alias("language"))
    model = fit(labelled)
    rows = rows.select(key, "declared", "host", "suffix", utf8("text").alias("_utf8"))
    found = fuse(written(text_evidence(rows, model), "evidence"), model)
    return found.select(key, "language", "probability", "text_language", "declared", "grams", "recognised")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of :func:`identify`: their language column is what they declare, their
    source is their host; they have no address."""
    source, lang = F.col("source").cast("string"), F.col("lang").cast("string")
    return docs.select("doc_id", "text", lang.alias("declared"), source.alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_rows(pages: DataFrame, text: DataFrame) -> DataFrame:
    """Pages with their extracted texts (``page_id, text``) as rows of :func:`identify`."""
    given = pages.select(
        "page_id", markup_language("html").alias("declared"), host_of("url").alias("host"), suffix_of("url").alias("suffix")
    )
    return given.join(text.select("page_id", "text"), "page_id")


def extracted_rows(found: DataFrame) -> DataFrame:
    """Pages as ``html_extract.extract`` gives them with ``declared``, as rows of :func:`identify`: one
    for each, whatever its id."""
    return found.select("page_id", "text", "declared", host_of("url").alias("host"), suffix_of("url").alias("suffix"))


def documents_languages(docs: DataFrame) -> DataFrame:
    """Verdicts on documents."""
    return identify(document_rows(docs), "doc_id")


def keep_recognised(docs: DataFrame) -> DataFrame:
    """Rows whose language is recognised; columns and rows as given.

    Each row is judged by itself, whatever other rows have its id: rows that agree in id, text,
    language and source share a verdict. The digests of rejected rows are few and go to an anti
    join. Null and empty texts are not recognised."""
    key = free_name(docs, "_row")
    keyed = docs.withColumn(key, row_key("doc_id", "text", "lang", "source"))
    source, lang = F.col("source").cast("string"), F.col("lang").cast("string")
    none = F.lit(None).cast("string")
    rows = keyed.select(F.col(key).alias("row"), "text", lang.alias("declared"), source.alias("host"), none.alias("suffix"))
    found = identify(rows, "row")
    rejected = written(found.where("not recognised").select(F.col("row").alias(key)).distinct(), "rejected")
    return keyed.join(rejected, key, "left_anti").select(*given_columns(docs))
