"""The public API: sync the ledger, embed, build the graph, re-block, search, update."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import messages
from fathomline.functions.texts import extension
from fathomline.operators import catalog, chunks, graph, search, store
from fathomline.operators.embed import Embedder, HashEmbedder, embed
from fathomline.plans.rules import Rule, with_rules
from fathomline.schemas import EDGES, LEDGER, QUERIES, VECTORS


class Engine:
    """Tables under one folder. A table is written beside the old one and then named in `current.json`, so readers see
    the old or the new version, never part of one."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, rules: list[Rule] = ()) -> None:
        self.spark, self.folder, self.embedder, self.rules = spark, folder.rstrip("/"), embedder or HashEmbedder(), list(rules)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Tables.

    def _current(self) -> dict[str, str]:
        p = f"{self.folder}/current.json"
        if not self._fs.exists(self._path(p)):
            return {}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(p).collect()))

    def _table(self, name: str, schema: str) -> DataFrame:
        now = self._current().get(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{now}") if now else self.spark.createDataFrame([], schema)

    def _write(self, **tables: DataFrame) -> None:
        now = self._current()
        for name, df in tables.items():
            new = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{new}")
            now[name] = new
        jvm = self.spark.sparkContext._jvm
        temporary, final = (self._path(f"{self.folder}/{n}") for n in (f".current-{uuid.uuid4().hex}", "current.json"))
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = rename
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), options)

    @property
    def ledger(self) -> DataFrame:
        return self._table("ledger", LEDGER)

    @property
    def embedded(self) -> DataFrame:
        """The ledger as of the last embedding: what the vectors were made from."""
        return self._table("embedded", LEDGER)

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTORS)

    @property
    def edges(self) -> DataFrame:
        return self._table("edges", EDGES)

    # Commands.

    def sync_ledger(self, files: DataFrame) -> DataFrame:
        """Replace the ledger by the entries of files (filepath, content, meta)."""
        self._write(ledger=catalog.entries(files))
        return self.ledger

    def cut(self, files: DataFrame) -> DataFrame:
        """Chunks of files (filepath, text, meta) by the rules of their extensions: (filepath, meta, start, end, chunk). Texts
        are read once, whatever splitters there are."""
        ruled = with_rules(files.select("filepath", "text", "meta", extension(F.col("filepath")).alias("extension")), self.rules)
        out = chunks.split_by(ruled.drop("extension"))
        kept = chunks.keep_chunks(out, F.col("min_length"), F.col("alphanumeric"))
        return kept.select("filepath", "meta", "start", "end", "chunk")

    def _embed(self, files: DataFrame) -> DataFrame:
        rows = embed(self.cut(files), self.embedder)
        return rows.withColumn("subset", F.struct("start", "end"))

    def embed(self, files: DataFrame, full: bool = False) -> DataFrame:
        """Embed all files (filepath, text, meta), or only those whose hash in the ledger differs from that of their last
        embedding; vectors of files that left the ledger go. The others keep their ids."""
        ledger = self.ledger
        old = self.vectors
        if full:
            old = old.limit(0)
            work = ledger
        else:
            work = catalog.stale(self.embedded, ledger)
            old = old.join(ledger.select("filepath"), "filepath", "left_semi").join(work.select("filepath"), "filepath", "left_anti")
        fresh = self._embed(files.join(work.select("filepath"), "filepath", "left_semi"))
        top = self.vectors.agg(F.max("id").alias("m")).head()["m"]
        first = 0 if full or top is None else top + 1
        new = store.with_blocks(store.assign_ids(fresh, "filepath", "start", "end", first=first))
        columns = [c.split()[0] for c in ("id", "filepath", "meta", "subset", "block", "data")]
        self._write(vectors=old.select(columns).unionByName(new.select(columns)), embedded=ledger)
        return self.vectors

    def build_index(self) -> DataFrame:
        members, edges = graph.build_graph(self.vectors)
        self._write(members=members, edges=edges)
        return self.edges

    def reblock(self, centroids: DataFrame) -> DataFrame:
        self._write(vectors=store.reblock(self.vectors, centroids, self.ledger))
        return self.vectors

    def count(self) -> int:
        return self.vectors.count()

    def get(self, ids: list[int] | DataFrame) -> DataFrame:
        """The stored rows of some ids."""
        return store.by_ids(self.vectors, ids)

    def log_query(self, text: str) -> int:
        """Append a query's text to the table of queries, under the time in microseconds, which is returned."""
        at = time.time_ns() // 1000
        self.spark.createDataFrame([(at, text)], QUERIES).coalesce(1).write.mode("append").parquet(f"{self.folder}/queries")
        return at

    @property
    def queries(self) -> DataFrame:
        path = f"{self.folder}/queries"
        return self.spark.read.schema(QUERIES).parquet(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], QUERIES)

    def handle(self, request: str, files: DataFrame | None = None) -> str:
        """The JSON answer to a JSON request: a query, or an edit of a file whose text is in files (filepath, text, meta)."""
        r = messages.parse_request(self.spark, request)
        if r["message_type"] == "query":
            self.log_query(r["payload"]["query"])
            return messages.response(self.search(r["payload"]["query"], r["payload"]["k"], r["payload"]["filters"] or []))
        self.update(files.where(F.col("filepath") == r["payload"]["filepath"]))
        return messages.response(self.spark.createDataFrame([], "filepath string, subset struct<start:bigint,end:bigint>"))

    def search(self, text: str, k: int = 10, filters: list[str] = ()) -> DataFrame:
        """(filepath, subset, distance) of the k nearest chunks that pass the filters."""
        query = self.embedder.embed([search.check_query(text)])[0].tolist()
        return search.results(search.search(self.vectors, query, k, list(filters)))

    def update(self, files: DataFrame) -> DataFrame:
        """Re-embed files (filepath, text, meta) that the store holds: their rows are replaced, their tags kept, and the
        removed nodes leave the graph."""
        known = files.join(self.vectors.select("filepath").distinct(), "filepath", "left_semi")
        after, dead = store.replace_files(self.vectors, self._embed(known).withColumn("id", F.lit(None).cast("bigint")).withColumn("block", F.lit(None).cast("bigint")))
        tables = {"vectors": after}
        if "edges" in self._current():
            tables["edges"] = graph.without_nodes(self.edges, dead)
        self._write(**tables)
        return self.vectors
