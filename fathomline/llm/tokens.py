"""Encoding of a corpus (problem 7), exact token counts, and token budgets by slice (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.bpe import VISIBLE, Chunks, Decoder, Vocabulary, _loaded, encoder
from fathomline.llm.longest_match import LongestMatch
from fathomline.session import bounded_batches

#: Rows of text turned into one Arrow batch of ids, and ids that are decoded at once.
ROWS_OUT, DECODED = 512, 4096


def _map_texts(docs: DataFrame, id_col: str, text_col: str, function, schema: str) -> DataFrame:
    """function(ids, texts) -> record batch, over slices of the rows; no other column reaches Python."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(i, ROWS_OUT)
                yield function(part.column(0), part.column(1).to_pylist())

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text, all of it ordinary text.

    vocabulary: path of a byte-level BPE file of the tokenizers library, readable on every executor. An empty or null
    text has an empty list; a repeated row comes out as often as it went in; other columns are not read.
    """

    def ids(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        data = [encoder(vocabulary).encode(t) for t in texts]
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum([len(d) // 4 for d in data], out=ends[1:])
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(data))])
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return _map_texts(docs, id_col, text_col, ids, "doc_id bigint, ids array<int>")


def decode_corpus(ids: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of lists of ids, by the incremental state machine in portions of DECODED ids; empty for an empty
    or null list. An id that the vocabulary doesn't have, or a null, is an error. A repeated row comes out as often as it went
    in."""
    bounded_batches(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(i, ROWS_OUT)
                texts, bytes_of = [], encoder(vocabulary).v.bytes_of
                for row in part.column(1).to_pylist():
                    d = Decoder(bytes_of)
                    texts.append("".join(d.feed(row[k : k + DECODED]) for k in range(0, len(row or ()), DECODED)) + d.finish())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def token_sizes(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the length of each row's list of ids; 0 for an empty or null text."""

    def sizes(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([encoder(vocabulary).count(t) for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    return _map_texts(docs, id_col, text_col, sizes, "doc_id bigint, n_tokens bigint")


class LongestMatchCounter:
    """Token counts of whole texts under a vocabulary, matched longest first within the tokenizer's pieces."""

    def __init__(self, vocabulary: str) -> None:
        self.match = LongestMatch(Vocabulary(vocabulary).bytes_of)
        self.chunks = Chunks(lambda p: self.match.count(p.encode()), sum, self._long)

    def _long(self, text: str, at: int, end: int) -> Iterator[int]:
        yield self.match.count(text[at:end].encode())

    def count(self, text: str) -> int:
        return sum(self.chunks.values(text))


def _counter(vocabulary: str) -> LongestMatchCounter:
    if ("longest", vocabulary) not in _loaded:
        _loaded["longest", vocabulary] = LongestMatchCounter(vocabulary)
    return _loaded["longest", vocabulary]


#: White_Space of Unicode, for Java's patterns.
_SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def cleaned(c: Column) -> Column:
    """Trimmed of Unicode white space and in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")), F.lit(""))


def tag_value(tag: Column, keys: str) -> Column:
    """The value of a free-form tag (`key:value`, with `=` or `/` as well, any case, blanks, leading dashes) of one of
    the keys (alternatives of a pattern), else null."""
    t = cleaned(tag)
    v = F.regexp_extract(t, rf"^-*{_SPACE}*(?:{keys}){_SPACE}*[:=/](.*)$", 1)
    return F.when(t.rlike(rf"^-*{_SPACE}*(?:{keys}){_SPACE}*[:=/]"), cleaned(v))


def file_tags(sources: DataFrame, lang_names: DataFrame) -> DataFrame:
    """(filepath, tag_lang, tag_domain) of the files of embed_sources that state any: the smallest where rows differ.

    Aggregated on the map side, so a path with many rows makes no hot task. lang_names: (alias, lang), a fixed table.
    """
    tags = sources.select("filepath", F.explode("meta").alias("tag")).where("filepath is not null and tag is not null")
    tags = tags.select("filepath", tag_value(F.col("tag"), "lang|language").alias("alias"), tag_value(F.col("tag"), "domain").alias("domain"))
    tags = tags.where("alias is not null or domain is not null").groupBy("filepath", "alias").agg(F.min("domain").alias("domain"))
    names = lang_names.select(F.lower(F.trim("alias")).alias("alias"), F.col("lang").alias("tag_lang"))
    return tags.join(names, "alias", "left").groupBy("filepath").agg(F.min("tag_lang").alias("tag_lang"), F.min("domain").alias("tag_domain"))


def document_slices(docs: DataFrame, sources: DataFrame, lang_names: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, lang, domain, n_tokens): each document with usable text, its token count and its slice.

    source: the column, cleaned, else the first segment of filepath. lang: the name in lang_names of the column, or
    where that is blank of the file's language tag, else `und`. domain: the file's domain tag, else `none`. Texts are
    read once, by the counting; only ids, paths and counts are shuffled.
    """
    # The slices' columns ride along, so that texts and attributes come from one scan.
    bounded_batches(docs.sparkSession)
    columns = ["doc_id", "source", "lang", "filepath"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(i, ROWS_OUT)
                texts = part.column(4).to_pylist()
                usable = [k for k, t in enumerate(texts) if t and VISIBLE.search(t)]
                counter = _counter(vocabulary)
                rows = pa.array(usable, pa.int64())
                n = pa.array([counter.count(texts[k]) for k in usable], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(4)), n], [*columns, "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("bigint"), "source", "lang", "filepath", "text").mapInArrow(
        run, "doc_id bigint, source string, lang string, filepath string, n_tokens bigint"
    )
    root = F.split_part("filepath", F.lit("/"), F.lit(1))
    d = counted.select(
        "doc_id", "filepath", "n_tokens", F.coalesce(cleaned(F.col("source")), root).alias("source"), cleaned(F.col("lang")).alias("alias")
    )
    names = lang_names.select(F.lower(F.trim("alias")).alias("alias"), F.col("lang").alias("own_lang"))
    d = d.join(names, "alias", "left").join(file_tags(sources, lang_names), "filepath", "left")
    lang = F.when(F.col("alias").isNotNull(), F.col("own_lang")).otherwise(F.col("tag_lang"))
    return d.select(
        "doc_id", "source", F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce("tag_domain", F.lit("none")).alias("domain"), "n_tokens"
    )


def token_budget(slices: DataFrame) -> DataFrame:
    """Totals by source, language and domain, and the roll-ups over them. `all_of` names the columns that a row is summed over
    (empty for a slice); in them null stands for all, while elsewhere null is a value of its own: a document without source
    and without path."""
    summed = F.array_compact(F.array(*[F.when(F.grouping(c) == 1, F.lit(c)) for c in ("source", "lang", "domain")]))
    totals = slices.cube("source", "lang", "domain").agg(summed.alias("all_of"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return totals.select("source", "lang", "domain", "all_of", "n_docs", "n_tokens")
