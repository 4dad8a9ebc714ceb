"""Language of web pages by Bayesian evidence fusion (operator 8).

Evidence about a page: the likelihood of its visible text under each language,
the language its markup declares, the suffix of its address, and a prior from
its host.  All statistics are grouped aggregates over whole tables:

1. Hashed byte trigrams of all labelled texts give a text model a language.
2. Pages are read once; each gets text likelihoods, and from them alone a first
   belief.
3. Sums of beliefs by declared language, by suffix, by host, by domain and over
   all pages give the likelihoods of declarations and suffixes and the priors.
   A host's prior is smoothed by its domain's, that by all pages'; a page's own
   belief is taken out of both first.

Groups are summed map-side before they are shuffled, so a host with a third of
all pages is a few rows.
"""

from __future__ import annotations

import html as htmllib
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bounded, settle
from .text import columns_of, map_slices, whole_text

BUCKETS = 1 << 14
#: Pseudo-counts: of a trigram, of a declaration or suffix, and how many pages a parent's prior counts as.
GRAM, FEATURE, PARENT = 0.5, 1.0, 5.0
#: Trigrams of a text overlap and repeat: the evidence counts as this share of their number, up to a most.
TEMPER, MOST_GRAMS = 0.2, 40
_HIDDEN = re.compile(r"<(script|style|template|noscript)\b", re.IGNORECASE)
# The whole opening tag, whose quoted values may hold any character.
_ROOT = re.compile(r"""<html\b((?:[^>"']|"[^"]*"|'[^']*')*+)""", re.IGNORECASE)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.IGNORECASE)
#: What may follow the start of a tag; any other "<" is text.
_TAG = re.compile(r"[A-Za-z/!?]")
#: Most languages that a model may have; bounds its broadcast table.
MAX_LANGUAGES = 200


def visible(page: str) -> str:
    """Text outside tags, comments, scripts and styles; one pass over the page.

    A "<" that no letter, slash, exclamation or question mark follows is text.
    What opens and never closes hides the rest of the page.
    """
    out, at = [], 0
    while True:
        start = page.find("<", at)
        if start < 0:
            out.append(page[at:])
            break
        out.append(page[at:start])
        if not _TAG.match(page, start + 1):
            out.append("<")
            at = start + 1
            continue
        hidden = _HIDDEN.match(page, start)
        if page.startswith("<!--", start):
            end, after = page.find("-->", start + 4), 3
        elif hidden:
            close = re.compile(f"</{hidden[1]}", re.IGNORECASE).search(page, hidden.end())
            end, after = (page.find(">", close.end()), 1) if close else (-1, 0)
        else:
            end, after = page.find(">", start), 1
        if end < 0:
            break
        out.append(" ")
        at = end + after
    return htmllib.unescape("".join(out))


def declared(page: str) -> str:
    """Primary code of the language that the markup declares, or an empty string."""
    root = _ROOT.search(page)
    found = _LANG.search(root[1]) if root else None
    return found[1].lower() if found else ""


def address(url: str) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (its last label); empty where there is none."""
    try:
        host = (urlsplit(url.strip()).hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".") if host else []
    if not labels or labels[-1].isdigit() or ":" in host:
        return host, host, ""
    return host, ".".join(labels[-2:]), labels[-1]


def grams(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of lower-cased letters, other runs as one space."""
    words = re.sub(r"[\W\d_]+", " ", text.lower())
    code = np.frombuffer(f" {words} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(code) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = (code[:-2] * np.uint32(65_599) + code[1:-1] * np.uint32(31_337) + code[2:]) * np.uint32(2_654_435_761)
    return np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)


def text_models(df: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (language, bucket) from all labelled texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, np.ndarray] = {}
        for name, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            sums[name] = sums.get(name, 0) + grams(t)
        names, at, n = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            names += [name] * len(used)
            at.append(used)
            n.append(counts[used])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(n), pa.int64())],
                                          names=["label", "bucket", "n"])

    rows = df.filter(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("string").alias("label"), whole_text(text).alias("text"))
    counted = map_slices(columns_of(rows, "label", "text"), work, "label string, bucket int, n long")
    summed = settle(counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r.label for r in summed.select("label").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages among the labels")
    table = summed.toArrow()
    counts = np.full((len(names), BUCKETS), GRAM)
    row = {name: i for i, name in enumerate(names)}
    at = np.array([row[x] for x in table["label"].to_pylist()], np.int64)
    counts[at, table["bucket"].to_numpy()] += table["n"].to_numpy()
    return names, np.log(counts / counts.sum(1, keepdims=True)) if names else counts


def identify(pages: DataFrame, texts: DataFrame, key: str = "page_id", url: str = "url", page: str = "html",
             text: str = "text", label: str = "lang") -> DataFrame:
    """``key``, ``host``, ``declared``, ``text_lang``, ``lang`` and ``probability`` of every page.

    ``texts`` has the labelled texts.  ``lang`` is the likeliest language, the
    first by name of equals; without any labelled text it is null, with
    probability null.  Null pages and addresses count as empty: no text
    evidence, no declaration, and the host ''.  A null key stays null; repeated
    rows each give a row and count each.  Pages of any length are read whole.
    An empty table gives no rows.  Other columns are ignored.  More than
    ``MAX_LANGUAGES`` labels raise an error, since the text models travel to every task.
    """
    names, model = text_models(texts, text, label)
    held = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = held.value
        likely, said = [], []
        for p in batch.column("text").to_pylist():
            counts = grams(visible(p))
            n = int(counts.sum())
            used = np.flatnonzero(counts)
            scale = min(n * TEMPER, MOST_GRAMS) / n if n else 0.0
            score = model[:, used] @ counts[used] * scale if len(model) else np.zeros(0)
            likely.append((score - score.max() if len(score) else score).tolist())
            said.append(declared(p))
        where = [address(u) for u in batch.column("url").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("row_key"), *[pa.array([w[i] for w in where], pa.string()) for i in range(3)],
             pa.array(said, pa.string()), pa.array(likely, pa.list_(pa.float64()))],
            names=["row_key", "host", "domain", "suffix", "declared", "likely"])

    rows = pages.select(F.col(f"`{key}`").alias("row_key"), whole_text(url).alias("url"), whole_text(page).alias("text"))
    seen = settle(map_slices(columns_of(rows, "row_key", "url", "text"), work,
                             f"row_key {kind}, host string, domain string, suffix string, declared string, likely array<double>"))
    if not names:
        return seen.select(F.col("row_key").alias(key), "host", "declared", F.lit(None).cast("string").alias("text_lang"),
                           F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    size = len(names)
    belief = [F.exp(F.col("likely")[i]) for i in range(size)]
    total = sum(belief[1:], belief[0])
    seen = seen.select("*", *[(b / total).alias(f"b{i}") for i, b in enumerate(belief)])

    def sums(prefix: str) -> list[Column]:
        return [F.sum(f"b{i}").alias(f"{prefix}{i}") for i in range(size)]

    whole = seen.agg(*sums("g"), F.count(F.lit(1)).alias("n")).first()
    n = whole["n"] or 0
    all_pages = [((whole[f"g{i}"] or 0.0) + 1.0) / (n + size) for i in range(size)]
    # A host has one domain: its sums travel with the host's, and pages are joined by host alone.
    hosts = seen.groupBy("host", "domain").agg(*sums("h"))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{i}").alias(f"m{i}") for i in range(size)])
    out = seen.join(hosts.join(domains, "domain").drop("domain"), "host")
    # Declarations and suffixes are mostly few; more than the limit are joined by shuffle.
    for column, prefix in (("declared", "d"), ("suffix", "s")):
        out = out.join(bounded(seen.groupBy(column).agg(*sums(prefix))), column)

    def rate(prefix: str, i: int) -> Column:
        """Likelihood of the page's declaration or suffix in a language, without the page itself, as a ratio to its share of all pages."""
        row = sum((F.col(f"{prefix}{j}") for j in range(1, size)), F.col(f"{prefix}0")) - 1.0
        share = (row + FEATURE) / (max(n - 1, 0) + FEATURE)
        own = F.greatest(F.col(f"{prefix}{i}") - F.col(f"b{i}"), F.lit(0.0))
        held_by = F.greatest(F.lit((whole[f"g{i}"] or 0.0)) - F.col(f"b{i}"), F.lit(0.0))
        return F.log(F.greatest((own + FEATURE * share) / (held_by + FEATURE), F.lit(1e-12)))

    scores = []
    for i in range(size):
        def without(prefix: str, i: int = i) -> Column:
            return F.greatest(F.col(f"{prefix}{i}") - F.col(f"b{i}"), F.lit(0.0))

        def rows_in(prefix: str) -> Column:
            return F.greatest(sum((F.col(f"{prefix}{j}") for j in range(1, size)), F.col(f"{prefix}0")) - 1.0, F.lit(0.0))

        domain = (without("m") + PARENT * all_pages[i]) / (rows_in("m") + PARENT)
        host = (without("h") + PARENT * domain) / (rows_in("h") + PARENT)
        scores.append(F.log(host) + F.col("likely")[i] + rate("d", i) + rate("s", i))
    out = out.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    spread = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("top")))
    languages = F.array(*[F.lit(x) for x in names])
    first = lambda values: F.get(languages, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    return out.select(F.col("row_key").alias(key), "host", "declared", first(F.col("likely")).alias("text_lang"),
                      first(F.col("scores")).alias("lang"), (1.0 / spread).alias("probability"))
