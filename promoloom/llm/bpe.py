"""Byte-pair encoding and decoding of whole texts (operator 3).

Texts become ids as the tokenizers library gives them for a lower-casing
byte-level vocabulary with word ends, and ids become text again.  Every text is
read once, in the task that scans it; nothing is shuffled.  Within a slice of
texts each distinct pre-token is merged once (``segmenttree``) and kept in a
bounded memo.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segmenttree import MergeTable
from .text import WHITE, columns_of, map_slices, special_splitter, whole_text

#: Pre-tokens kept between slices; the memo starts anew beyond it.
MEMO = 200_000
# Fixed value: how the vocabulary's own file splits words.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def lower_each(text: str) -> str:
    """Lower case character by character, as the vocabulary's normaliser does.

    ``str.lower`` differs at one place: it looks around a capital sigma.
    """
    return text.replace("Σ", "σ").lower()


class Encoder:
    """Ids of texts, one bounded memo a task."""

    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.split = regex.compile(SPLIT)
        self.special = special_splitter(list(self.table.special))
        self.memo: dict[str, tuple[str, str, int]] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings stand for themselves."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        return self.split.findall(lower_each(unicodedata.normalize("NFC", text)))

    def learn(self, texts: list[list[str]]) -> None:
        """Put every pre-token of these texts into the memo."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*texts) - self.memo.keys()) if texts else []
        plain = [p for p in new if p not in self.table.special]
        for p in new:
            if p in self.table.special:
                self.memo[p] = (str(self.table.special[p]), p, 1)
        for p, ids in zip(plain, self.table.encode([p.encode() for p in plain])):
            self.memo[p] = (" ".join(map(str, ids)), " ".join([self.table.tokens[i] for i in ids]), len(ids))

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        pieces = self.pieces(text)
        self.learn([pieces])
        return [int(i) for p in pieces for i in self.memo[p][0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join([self.table.tokens[i] for i in ids if i in self.table.tokens])


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 digests: bool = False) -> DataFrame:
    """Encode every text, then decode its ids.

    Returns one row per row of ``df``: the key, ``n_tokens`` and, with
    ``digests``, ``ids_sha256`` and ``decoded_sha256`` (SHA-256 of the decimal
    ids joined by spaces and of the decoded text), else ``ids`` and ``decoded``.

    Null text counts as empty: no ids, empty decoded text.  A null key stays
    null; repeated rows each give a row.  Texts of any length are encoded whole,
    in n log n steps.  An empty table gives no rows.  Other columns are ignored.
    """
    field = df.schema[key]
    schema = T.StructType([T.StructField(key, field.dataType), T.StructField("n_tokens", T.LongType())])
    for name in ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"):
        kind = T.ArrayType(T.IntegerType()) if name == "ids" else T.StringType()
        schema = schema.add(name, kind)
    encoders: list[Encoder] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not encoders:
            encoders.append(Encoder(path))
        enc = encoders[0]
        texts = [enc.pieces(t) for t in batch.column("text").to_pylist()]
        enc.learn(texts)
        n, first, second = [], [], []
        for pieces in texts:
            found = [enc.memo[p] for p in pieces]
            ids, words = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
            n.append(sum([x[2] for x in found]))
            if digests:
                first.append(hashlib.sha256(ids.encode()).hexdigest())
                second.append(hashlib.sha256(words.encode()).hexdigest())
            else:
                first.append([int(i) for i in ids.split()])
                second.append(words)
        cols = [batch.column(key), pa.array(n, pa.int64()),
                pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    rows = df.select(F.col(f"`{key}`"), whole_text(text).alias("text"))
    return map_slices(columns_of(rows, key, "text"), work, schema)
